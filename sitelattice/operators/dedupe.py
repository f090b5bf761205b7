"""Order-dependent perceptual deduplication, near-duplicate pairs and file naming."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelattice.functions import constants as C
from sitelattice.functions import fingerprints as fp
from sitelattice.functions import names


def _greedy(batches, most: int, bits: int, dedupe: bool):
    """Rows sorted by site and address; the state is one site's saved images, at most ``most``."""
    site, saved, marks, area, counted = object(), [], None, None, 0

    def flush():
        if saved:
            s, u, replaced = zip(*saved)
            yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(u), pa.array(replaced, pa.int32())], ["site", "asset_url", "replaced"])

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("site", "asset_url", "r", "g", "b", "area")]
        for s, url, r, g, b, size in zip(*columns):
            if s != site:
                yield from flush()
                site, saved, counted = s, [], 0
                marks, area = np.zeros((most, 3), np.int64), np.full(most, -1, np.int64)
            if counted >= most:
                continue
            hit = -1
            if dedupe and r is not None:
                differ = np.bitwise_count((marks[:counted] ^ np.array([r, g, b])).view(np.uint64))
                near = np.flatnonzero((differ <= bits).all(1) & (area[:counted] >= 0))
                hit = int(near[0]) if len(near) else -1
            if hit < 0:
                saved.append((s, url, 0))
                if r is not None:
                    marks[counted], area[counted] = (r, g, b), size
                counted += 1
            elif size > area[hit]:
                saved[hit] = (s, url, saved[hit][2] + 1)
                marks[hit], area[hit] = (r, g, b), size
    yield from flush()


def greedy_dedupe(images: DataFrame, most: int = C.MAX_IMAGES, bits: int = C.NEAR_BITS, dedupe: bool = True) -> DataFrame:
    """(site, asset_url, replaced): what each site keeps, going through its images in address order.

    An image near a kept one replaces it in its place if it has more pixels, else is
    dropped; one without fingerprint is kept; a site stops at ``most``.  The rule is
    neither symmetric nor transitive, so it is run in order, as a scan of sorted
    rows whose state is bounded by ``most``: a site of any size streams through.
    """
    rows = images.select("site", "asset_url", "r", "g", "b", fp.pixel_area("w", "h").alias("area"))
    rows = rows.repartition("site").sortWithinPartitions("site", "asset_url")
    schema = rows.select("site", "asset_url").schema.add("replaced", T.IntegerType())
    return rows.mapInArrow(partial(_greedy, most=most, bits=bits, dedupe=dedupe), schema)


def capped(images: DataFrame, most: int = C.MAX_IMAGES) -> DataFrame:
    """The first ``most`` assets of each site in address order.

    The window is preceded by a limit on ranks that Spark pushes below the
    shuffle, so that each task hands on at most ``most`` rows of a site.
    """
    return images.withColumn("position", F.row_number().over(Window.partitionBy("site").orderBy("asset_url"))).where(F.col("position") <= most)


def fingerprint_classes(images: DataFrame) -> DataFrame:
    """(r, g, b, rep, n): one row for each distinct fingerprint; uniform images all share one."""
    return images.where("r IS NOT NULL").groupBy("r", "g", "b").agg(F.min("asset_url").alias("rep"), F.count("*").alias("n"))


def _band_masks(bits: int, strided: bool = False) -> list[int]:
    """``bits + 1`` bands of a 64-bit hash, as signed masks: runs of bits, or every ``bits + 1``-th bit."""
    edge = [64 * i // (bits + 1) for i in range(bits + 2)]
    bands = [range(i, 64, bits + 1) for i in range(bits + 1)] if strided else [range(a, b) for a, b in zip(edge, edge[1:])]
    masks = [sum(1 << i for i in band) for band in bands]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def near_pairs(classes: DataFrame, bits: int = C.NEAR_BITS) -> DataFrame:
    """(a, b): representatives of distinct fingerprints that are near.

    Each hash is cut into ``bits + 1`` bands: two that differ in at most ``bits`` bits
    agree in one of them.  As all channels must be near, a pair agrees in a band of
    red and in a band of green; each such pair of bands is a key of an equi-join, so
    none is missed, and images alike in one channel only do not meet.  Bands of red are
    runs of bits and bands of green are spread over the hash, so that a key tells
    grey images, whose channels are the same, apart as well as others.  A pair is
    looked at under the first of its keys only, so none comes twice.  Each fingerprint
    makes ``(bits + 1) ** 2`` rows, which no size estimate sees: the join is always
    a sorted one, nothing is sent to the driver.
    """
    masks = {"r": _band_masks(bits), "g": _band_masks(bits, strided=True)}
    band = lambda c, i: F.struct(F.lit(i).alias("i"), F.col(c).bitwiseAND(F.lit(masks[c][i])).alias("v"))
    rows = classes.select("rep", "r", "g", "b", *(F.array(*(band(c, i) for i in range(bits + 1))).alias(f"{c}s") for c in "rg"))
    rows = rows.withColumn("x", F.explode("rs")).withColumn("y", F.explode("gs"))
    side = lambda s: rows.select(F.col("rep").alias(s), *(F.col(c).alias(f"{s}{c}") for c in "rgb"), F.col("x.i").alias("i"), F.col("y.i").alias("j"), F.col("x.v").alias("v"), F.col("y.v").alias("w"))

    def first_equal(c: str) -> Column:
        differ = F.col(f"a{c}").bitwiseXOR(F.col(f"b{c}"))
        return F.coalesce(*(F.when(differ.bitwiseAND(F.lit(m)) == 0, F.lit(i)) for i, m in enumerate(masks[c])))

    near = fp.is_near({c: F.col(f"a{c}") for c in "rgb"}, {c: F.col(f"b{c}") for c in "rgb"}, bits)
    pairs = side("a").join(side("b").hint("merge"), ["i", "j", "v", "w"]).where(near & (first_equal("r") == F.col("i")) & (first_equal("g") == F.col("j")) & (F.col("a") < F.col("b")))
    return pairs.select("a", "b")


def _free_names(batches, folder: str, columns: list[str], classic: bool):
    """Rows sorted by folder and order; the state is the names of one folder."""
    at, taken, following = object(), set(), {}

    def candidate(base: str, ext: str, k: int) -> str:
        if classic:
            return f"{base}_{k}{ext}" if k else base + ext
        if not k:
            return f"{base}.{ext}" if ext else base
        suffix = f" {k}"
        room = max(1, C.MAX_FILENAME - (len(ext) + 1 if ext else 0) - len(suffix))
        stem = (base[:room].strip(". _-") or "file") + suffix
        return f"{stem}.{ext}" if ext else stem

    seen = (lambda n: n) if classic else str.lower
    for batch in batches:
        out = []
        for f, base, ext in zip(batch.column(folder).to_pylist(), batch.column("_base").to_pylist(), batch.column("_ext").to_pylist()):
            if f != at:
                at, taken, following = f, set(), {}
            if base is None:
                out.append(None)
                continue
            key = seen(candidate(base, ext, 0))
            k = following.get(key, 0)
            while seen(name := candidate(base, ext, k)) in taken:
                k = k + 1 if k or classic else 2
            following[key] = k
            taken.add(seen(name))
            out.append(name)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(out, pa.string())], [*columns, "file_name"])


def unique_names(files: DataFrame, folder: str = "folder", name: str = "name", order: str = "asset_url", classic: bool = False) -> DataFrame:
    """``files`` with ``file_name``: sanitised, and numbered until it is free where its folder has it already.

    Files of a folder are named in order: the plain name, else `` 2``, `` 3`` and so
    on, the first that no file before has, without regard to case.  The classic rule
    neither cleans nor folds names and numbers them ``_1``, ``_2``.  A folder holds a
    site's capped downloads, so the names that a task remembers are few; rows
    stream through it, folder by folder.  A null name stays null.
    """
    if classic:
        ext = F.regexp_extract(name, r"(?s)^\.*[^.].*(\.[^.]*)$", 1)  # from the last dot on, unless only dots are before it
        rows = files.withColumn("_ext", ext).withColumn("_base", F.expr(f"left(`{name}`, length(`{name}`) - length(_ext))"))
    else:
        base, ext = names.split_name(names.sanitize_filename(name))
        rows = files.withColumn("_base", base).withColumn("_ext", ext)
    rows = rows.repartition(folder).sortWithinPartitions(folder, order, name)
    return rows.mapInArrow(partial(_free_names, folder=folder, columns=files.columns, classic=classic), T.StructType([*files.schema.fields, T.StructField("file_name", T.StringType())]))


def classic_downloads(fetches: DataFrame, most: int = C.MAX_IMAGES, least: int = C.MIN_PIXELS_CLASSIC) -> DataFrame:
    """(site, asset_url, kind, outcome): what the classic run handles, in address order, until it has saved ``most``.

    ``fetches(site, asset_url, w, h, declared_len, len)``.  Skipped addresses and
    kinds that are neither image nor video are not handled and not counted; there
    are no fingerprints.  What stands behind the last saved asset is never reached.
    The address of that one comes from a ranking that Spark cuts before the shuffle.
    """
    from sitelattice.functions import urls
    from sitelattice.operators import select

    kind = select.media_kind("asset_url", classic=True)
    rows = fetches.where(~urls.is_skipped("asset_url")).withColumn("kind", kind).where("kind <> 'other'")
    rows = rows.withColumn("outcome", select.outcome(F.col("kind"), F.col("w"), F.col("h"), F.col("declared_len"), F.col("len"), least)).select("site", "asset_url", "kind", "outcome")
    last = capped(rows.where("outcome = 'ok'").select("site", "asset_url"), most).where(F.col("position") == most).select("site", F.col("asset_url").alias("last"))
    return rows.join(last, "site", "left").where("last IS NULL OR asset_url <= last").drop("last")
