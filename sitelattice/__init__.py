"""Site-media analytics on Spark: crawled pages to a clean, de-duplicated inventory of media assets."""
