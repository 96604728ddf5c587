"""Training-data operators: language, mixing, extraction, deduplication, media, secrets, shards, tokens, toxicity,
phrases, manifests.

Nothing else in the library imports this subpackage. Conventions held by every module:

* an operator takes a DataFrame and column names, reads only those columns, and returns a DataFrame;
  other columns, whatever their names, neither change nor enter its result;
* Python runs only inside ``mapInArrow`` / ``applyInArrow`` / ``arrow_udf`` tasks on bounded Arrow batches;
* intermediate tables that a later job reads again are written below ``spark.checkpoint.dir``.
"""
