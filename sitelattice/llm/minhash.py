"""Near-duplicates: MinHash with tensored banding, confirmed on full shingle sets.

Two small collections A and B of ``TUPLES`` tuples of ``WIDTH`` minhashes each
are computed for a document.  The tables are all pairs (A_i, B_j): two documents
are candidates if they agree in some A_i and in some B_j.  So 2 * 26 * 5 = 260
minhashes make 26 * 26 tables of ten minhashes each.  Two sets of similarity s
are missed with probability 1 - (1 - (1 - s**5)**26)**2: 7e-5 at 0.8, 5e-7 at 0.85.

Nothing emits all pairs of a table.  Documents with one shingle set form a class
first.  Then

1. each A-bucket has a pivot, the class with the most copies; every class is
   compared with the first-ranked pivot of the buckets it is in;
2. linked classes become components by large-star / small-star rounds;
3. only buckets that still hold several components go on: there all pairs across
   components that agree in some B_j are compared.  Buckets are cut into cells
   of bounded size, so that no task ever holds a large one, and where a bucket
   has very many such pairs the full sets travel with the cells and links are
   confirmed in place.

A link needs 100 * intersection >= 80 * union of the full sets.

Cases: a null or blank text has an empty set and links with nothing; a single
word is a shingle of its own.  Rows with a null identifier link with nothing and
are kept.  Rows that share an identifier are one node, kept or dropped together.
Empty tables give empty results.  Extra columns do not matter, whatever their names.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelattice.llm import textvec
from sitelattice.llm.groups import whole_groups
from sitelattice.llm.runtime import BROADCAST_ROWS, Scratch, components, few_or_joined, local_stars, segment_sum, table

TUPLES, WIDTH = 26, 5
#: Members of a cell, and of the other side of a cell, at most.
CELL = 512
#: Pairs for each member from which on a cell carries its full sets.
DENSE = 1
#: Partners from which on a document's set is sent to several parts.
PARTNERS = 1024

_rng = np.random.default_rng(710)
_XOR = _rng.integers(0, 1 << 32, 2 * TUPLES * WIDTH, dtype=np.uint32)
_ODD = _rng.integers(0, 1 << 32, 2 * TUPLES * WIDTH, dtype=np.uint32) | np.uint32(1)


def shingle_sets(column: pa.Array, n: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingle hashes (51 bits, sorted) of all rows end to end; where each row's begin.

    A row with fewer words, but at least one, has its whole word sequence as its one shingle.
    """
    words = textvec.words(column)
    value, start = words.grams(n)
    owner = words.doc[start]
    count = np.diff(words.first)
    for k in range(1, n):
        short = np.flatnonzero(count == k)
        if len(short):
            whole = words.hash[words.first[short]]
            for i in range(1, k):
                whole = textvec.mix(whole * np.uint64(3) + words.hash[words.first[short] + i], i)
            value, owner = np.concatenate([value, textvec.mix(whole, 100 + k)]), np.concatenate([owner, short])
    rows = len(words.at) - 1
    keys = np.unique(owner.astype(np.uint64) << np.uint64(51) | value >> np.uint64(13))
    return keys & np.uint64((1 << 51) - 1), np.searchsorted(keys >> np.uint64(51), np.arange(rows + 1, dtype=np.uint64))


def _bounded(batch: pa.RecordBatch, column: str):
    """Slices of at most 8192 rows: the row number must fit beside the shingle."""
    for rows in textvec.slices(batch, column):
        for i in range(0, rows.num_rows, 8192):
            yield rows.slice(i, 8192)


def signatures(docs: DataFrame, n: int = 2) -> DataFrame:
    """doc_id, n_shingles, d1, d2 (digest of the set), a (keys of collection A), b (those of B)."""

    def task(batches):
        for batch in batches:
            for rows in _bounded(batch, "text"):
                sets, first = shingle_sets(rows.column("text"), n)
                size = np.diff(first)
                some = np.flatnonzero(size)
                short = (textvec.mix(sets, 5) >> np.uint64(32)).astype(np.uint32)
                keys = np.zeros((rows.num_rows, 2 * TUPLES), np.uint64)
                scratch = np.empty_like(short)
                for t in range(2 * TUPLES):
                    key = np.full(len(some), t, np.uint64)
                    for k in range(t * WIDTH, (t + 1) * WIDTH):
                        np.bitwise_xor(short, _XOR[k], out=scratch)
                        np.multiply(scratch, _ODD[k], out=scratch)
                        least = np.minimum.reduceat(scratch, first[some]) if len(some) else np.zeros(0, np.uint32)
                        key = textvec.mix(key * np.uint64(0xA0761D6478BD642F) + least)
                    keys[some, t] = key
                a = pa.array(keys[:, :TUPLES].ravel().view(np.int64))
                b = pa.array(keys[:, TUPLES:].astype(np.uint32).ravel().view(np.int32))
                at = pa.array(np.arange(0, TUPLES * rows.num_rows + 1, TUPLES, dtype=np.int32))
                digest = [pa.array(segment_sum(textvec.mix(sets, s), first).astype(np.uint64).view(np.int64)) for s in (1, 2)]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(size), *digest, pa.ListArray.from_arrays(at, a), pa.ListArray.from_arrays(at, b)], ["doc_id", "n_shingles", "d1", "d2", "a", "b"])

    return docs.select("doc_id", "text").mapInArrow(task, "doc_id long, n_shingles long, d1 long, d2 long, a array<long>, b array<int>")


def full_sets(docs: DataFrame, ids: DataFrame, n_ids: int, scratch: Scratch, n: int = 2) -> DataFrame:
    """(id, set) of the named documents: the sorted shingle hashes as bytes."""

    def task(batches):
        for batch in batches:
            for rows in _bounded(batch, "text"):
                sets, first = shingle_sets(rows.column("text"), n)
                cells = [sets[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array(cells, pa.binary())], ["id", "set"])

    named = few_or_joined(docs.select(F.col("doc_id").alias("id"), "text"), ids, ["id"], n_ids)
    return scratch.keep(named.mapInArrow(task, "id long, set binary").dropDuplicates(["id"]), "sets")


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def confirm(docs: DataFrame, pairs: DataFrame, scratch: Scratch, n: int, percent: int) -> DataFrame:
    """The pairs (x, y) whose full sets are similar enough."""

    def task(batches):
        for batch in batches:
            keep = [
                _similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)
                for x, y in zip(batch.column("sx").to_pylist(), batch.column("sy").to_pylist())
            ]
            yield batch.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    ids = scratch.keep(pairs.select(F.explode(F.array("x", "y")).alias("id")).distinct(), "ids")
    sets = full_sets(docs, ids, ids.count(), scratch, n)
    # a document with very many partners is dealt out: its set to several parts, each partner to one of them
    crowded = scratch.keep(pairs.groupBy("y").agg(F.count("*").alias("n")).where(F.col("n") > PARTNERS).select("y", F.ceil(F.col("n") / PARTNERS).cast("int").alias("parts")), "crowded")
    few = crowded.count() <= BROADCAST_ROWS
    parts = F.coalesce("parts", F.lit(1))
    crowded = F.broadcast(crowded) if few else crowded
    pairs = pairs.join(crowded, "y", "left").select("x", "y", F.pmod(F.xxhash64("x"), parts).cast("int").alias("part"))
    other = sets.select(F.col("id").alias("y"), F.col("set").alias("sy")).join(crowded, "y", "left")
    other = other.select("y", "sy", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    joined = pairs.join(sets.select(F.col("id").alias("x"), F.col("set").alias("sx")), "x")
    joined = joined.where(F.length("sx") > 0).join(other, ["y", "part"])
    # the smaller set must be large enough for the larger one
    joined = joined.where(100 * F.least(F.length("sx"), F.length("sy")) >= percent * F.greatest(F.length("sx"), F.length("sy")))
    edges = scratch.keep(joined.select("x", "y", "sx", "sy").mapInArrow(task, "x long, y long"), "links")
    scratch.drop(sets, ids)
    return edges


def _agree(b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return (b[i] == b[j]).any(1)


def _first_shared(a: np.ndarray, i: np.ndarray, j: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether ``key`` is the first A-key that rows i and j share: a pair is looked at in one bucket only."""
    same = a[i] == a[j]
    return a[i, same.argmax(1)] == key


def _local_pairs(key, role, node, label, a, b, starts):
    """Candidate pairs (indices) of whole cells, in pieces of bounded size."""
    small, big = [], []
    for s, e in zip(starts[:-1], starts[1:]):
        (small if role[s] == 0 and e - s <= 128 else big).append((s, e))

    def tested(i, j):
        ok = label[i] != label[j]
        i, j = i[ok], j[ok]
        ok = _agree(b, i, j)
        i, j = i[ok], j[ok]
        ok = _first_shared(a, i, j, key[i])
        return i[ok], j[ok]

    todo_i, todo_j, total = [], [], 0
    for s, e in small:
        i, j = np.triu_indices(e - s, 1)
        todo_i.append(i + s)
        todo_j.append(j + s)
        total += len(i)
        if total > 100_000:
            yield tested(np.concatenate(todo_i), np.concatenate(todo_j))
            todo_i, todo_j, total = [], [], 0
    if total:
        yield tested(np.concatenate(todo_i), np.concatenate(todo_j))
    for s, e in big:
        here = np.arange(s, e)
        ones = here if role[s] == 0 else here[role[s:e] == 2]
        others = here if role[s] == 0 else here[role[s:e] == 1]
        foreign = np.unique(node[ones]) if role[s] else np.zeros(0, np.int64)
        residual = np.isin(node[s:e], foreign)
        parts = []
        for r in ones:
            m = others[others > r] if role[s] == 0 else others[(node[others] != node[r])]
            if role[s]:  # both residual: once only
                m = m[(node[m] > node[r]) | ~residual[m - s]]
            parts.append(tested(np.full(len(m), r), m))
        yield np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(name)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _cells_task(batches, percent: int):
    """Cells to rows (x, y, kind): kind 0 a candidate pair, 1 a confirmed link, 2 a dense cell (x: key, y: part)."""
    for table_, starts in whole_groups(batches, ["key", "part"]):
        key, part, role, node, label = (table_.column(c).to_numpy(zero_copy_only=False) for c in ("key", "part", "role", "rep", "label"))
        a, b = _matrix(table_, "a"), _matrix(table_, "b")
        sets = table_.column("set").to_pylist() if "set" in table_.schema.names else None
        x, y, kind = [], [], []
        for i, j in _local_pairs(key, role, node, label, a, b, starts):
            if not len(i):
                continue
            if sets is not None:
                i, j = _confirmed(sets, i, j, percent)
                a_, b_ = local_stars(node[i], node[j])  # connects as much, in no more rows than members
                x.append(a_), y.append(b_), kind.append(np.ones(len(a_), np.int32))
                continue
            owner = np.searchsorted(starts, i, "right") - 1
            many = np.bincount(owner, minlength=len(starts) - 1) > DENSE * np.diff(starts)
            few, full = ~many[owner], np.flatnonzero(many)
            x.append(node[i[few]]), y.append(node[j[few]]), kind.append(np.zeros(few.sum(), np.int32))
            x.append(key[starts[full]]), y.append(part[starts[full]]), kind.append(np.full(len(full), 2, np.int32))
        if x:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (x, y, kind)], ["x", "y", "kind"])


def _confirmed(sets: list[bytes], i: np.ndarray, j: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs similar enough; all partners of one row are compared with it at once."""
    used = np.unique(np.concatenate([i, j]))
    place = {int(r): k for k, r in enumerate(used)}
    parts = [np.frombuffer(sets[r], np.uint64) for r in used]
    first = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    names, ids = np.unique(np.concatenate(parts), return_inverse=True)
    size, seen = np.diff(first), np.zeros(len(names), bool)
    good = np.zeros(len(i), bool)
    order = np.argsort(i, kind="stable")
    cut = np.flatnonzero(np.diff(i[order], prepend=-1, append=-1))
    for s, e in zip(cut[:-1], cut[1:]):
        rows = order[s:e]
        own = place[int(i[rows[0]])]
        seen[ids[first[own] : first[own + 1]]] = True
        partners = np.array([place[int(r)] for r in j[rows]])
        both = segment_sum(seen[ids].astype(np.int32), first)[partners]
        seen[ids[first[own] : first[own + 1]]] = False
        good[rows] = 100 * both >= percent * (size[own] + size[partners] - both)
    return i[good], j[good]


def near_duplicates(docs: DataFrame, n: int = 2, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs(doc_id, text)``."""
    scratch = Scratch(docs.sparkSession, "minhash")
    found = scratch.keep(signatures(docs, n), "signatures")
    classes = found.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2", "n_shingles")
    classes = scratch.keep(classes.agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("a").alias("a"), F.first("b").alias("b")), "classes")
    rows = classes.select("rep", "copies", F.explode("a").alias("key"))
    buckets = rows.groupBy("key").agg(F.count("*").alias("n"), F.max(F.struct("copies", (-F.col("rep")).alias("rep"))).alias("pivot")).where("n > 1").select("key", "n", "pivot.copies", (-F.col("pivot.rep")).alias("pivot"))
    buckets = scratch.keep(buckets, "buckets")  # stored, so that Spark can split the join where very many rows have one key
    members = scratch.keep(rows.select("rep", "key").join(buckets, "key"), "members")

    sides = classes.select("rep", "b")
    star = members.where("rep <> pivot").groupBy("rep").agg(F.max(F.struct("copies", (-F.col("pivot")).alias("pivot"))).alias("p"))
    star = star.select(F.col("rep").alias("x"), (-F.col("p.pivot")).alias("y"))
    star = star.join(sides.toDF("x", "bx"), "x").join(sides.toDF("y", "by"), "y").where(F.arrays_overlap("bx", "by")).select("x", "y")
    star = scratch.keep(star, "pairs")
    links = confirm(docs, star, scratch, n, percent)
    stars = components(links.toDF("a", "b"), scratch)

    labelled = members.join(stars.toDF("rep", "component"), "rep", "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("label"))
    labelled = scratch.keep(labelled, "labelled")
    scratch.drop(members, star, buckets)
    mixed = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    mixed = scratch.keep(mixed, "mixed")
    open_ = scratch.keep(labelled.join(mixed, "key", "left_semi"), "open")
    cells = _cut_into_cells(open_)
    cells = cells.join(classes.select("rep", "a", "b"), "rep")
    compared = scratch.keep(_run_cells(cells, percent), "compared")
    pairs = scratch.keep(compared.where("kind = 0").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "pairs")
    links = stars.toDF("x", "y").union(confirm(docs, pairs, scratch, n, percent))
    dense = compared.where("kind = 2").select(F.col("x").alias("key"), F.col("y").alias("part")).distinct()
    if not dense.isEmpty():
        full = scratch.keep(cells.join(dense, ["key", "part"]), "dense")
        ids = full.select(F.col("rep").alias("id")).distinct()
        sets = full_sets(docs, ids, ids.count(), scratch, n)
        links = links.union(_run_cells(full.join(sets.toDF("rep", "set"), "rep"), percent).select("x", "y"))
    joined = components(links.toDF("a", "b"), scratch)

    named = classes.select("d1", "d2", "n_shingles", "rep").join(joined.toDF("rep", "component"), "rep", "left").select("d1", "d2", "n_shingles", F.coalesce("component", "rep").alias("component"))
    out = found.select("doc_id", "n_shingles", "d1", "d2").join(named, ["d1", "d2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _cut_into_cells(open_: DataFrame) -> DataFrame:
    """(key, part, role, rep, label): whole small buckets (role 0); of large ones, cells of a
    block of members (role 1) and a block of those outside the bucket's largest component (role 2)."""
    small = open_.where(F.col("n") <= CELL).select("key", F.lit(0).cast("long").alias("part"), F.lit(0).alias("role"), "rep", "label")
    large = open_.where(F.col("n") > CELL)
    by_label = large.groupBy("key", "label").agg(F.count("*").alias("m"))
    core = by_label.groupBy("key").agg(F.max(F.struct("m", "label")).alias("core"), F.sum("m").alias("total"))
    large = large.join(core, "key")
    blocks = F.ceil(F.col("total") / CELL).cast("int")
    outer = F.greatest(F.ceil((F.col("total") - F.col("core.m")) / CELL).cast("int"), F.lit(1))
    mine = F.pmod(F.xxhash64("rep", F.lit(3)), blocks).cast("int")
    side = F.pmod(F.xxhash64("rep", F.lit(4)), outer).cast("int")
    numbered = lambda m, r: (m.cast("long") * (1 << 31) + r.cast("long") + 1).alias("part")
    as_member = large.select("key", F.explode(F.sequence(F.lit(0), outer - 1)).alias("r"), mine.alias("m"), "rep", "label").select("key", numbered(F.col("m"), F.col("r")), F.lit(1).alias("role"), "rep", "label")
    outside = large.where("label <> core.label")
    as_other = outside.select("key", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("m"), side.alias("r"), "rep", "label").select("key", numbered(F.col("m"), F.col("r")), F.lit(2).alias("role"), "rep", "label")
    return small.unionByName(as_member).unionByName(as_other)


def _run_cells(cells: DataFrame, percent: int) -> DataFrame:
    return cells.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(partial(_cells_task, percent=percent), "x long, y long, kind int")


def op7(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8), with its own columns."""
    gone = near_duplicates(docs, n=5).where("NOT kept").select(F.col("doc_id").alias("_id"))
    gone = Scratch(spark, "minhash-stage").keep(gone.distinct(), "gone")
    few = gone.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(gone) if few else gone, docs["doc_id"] == gone["_id"], "left_anti")


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) > 1 THEN [words[i] || ' ' || words[i + 1] FOR i IN range(1, len(words))] ELSE words END) AS shingles FROM w),
s AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM sets),
near AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
links AS (SELECT x, y FROM near UNION ALL SELECT y, x FROM near),
reach(doc_id, node) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, links.y FROM reach JOIN links ON reach.node = links.x),
c AS (SELECT doc_id, min(node) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, len(shingles)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN c USING (doc_id)
"""
