"""Full-text search: a weighted positional index and web-style queries as joins. Filtering only, no ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nested import bound
from ..functions.stemming import stem, stem_all
from .ordered import stored
from .stored_index import StoredIndex

# The English stop words that text indexes commonly leave out.
STOP_WORDS = tuple(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that"
    " these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during"
    " before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own"
    " same so than too very s t can will just don should now".split()
)
WEIGHTS = {"title": "A", "employer": "B", "description": "C"}


def tokens(c: Column) -> Column:
    """Lower-case words of letters and digits, in order, stop words in their places."""
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != "")


def build_index(df: DataFrame, fields: dict[str, str], id_col: str = "id", stemmed: bool = False) -> DataFrame:
    """(term, id, weight, pos) of all fields; ``fields`` gives a column for each weight. ``stemmed`` terms are English stems.

    ``stored_index.write_index`` keeps such rows (not stemmed) for searches that read only their words' blocks.
    """
    parts = [df.select(F.col(id_col).alias("id"), F.lit(w).alias("weight"), F.posexplode(_terms(F.col(c), stemmed)).alias("pos", "term")) for w, c in fields.items()]
    return reduce(DataFrame.union, parts).filter("term IS NOT NULL")


def _terms(c: Column, stemmed: bool) -> Column:
    """Terms of a text in their places, null in those of stop words; a text's words are stemmed together."""
    kept = F.transform(tokens(c), lambda w: F.when(~w.isin(*STOP_WORDS), w))
    return stem_all(kept) if stemmed else kept


def term_sizes(df: DataFrame, text: str, id_col: str = "id", stemmed: bool = False) -> DataFrame:
    """(term, docs, places, at) of the index of one field: different ids, places and the sum of their numbers.

    Rows of an id that has several are few or none; a term's documents are its rows, less those of the same id. So no pair
    of term and document leaves a task, only sums by term.
    """
    own = df.select(F.col(id_col).alias("id"), _terms(F.col(text), stemmed).alias("terms"))
    place = lambda w, i: F.struct(w.alias("term"), i.alias("pos"))
    both = lambda e: F.concat(F.transform(e, place), F.transform(F.array_distinct(e), lambda w: place(w, F.lit(None).cast("int"))))
    rows = own.select(F.col("id").isNotNull().alias("named"), F.explode(bound(F.col("terms"), both)).alias("p")).filter("p.term IS NOT NULL")
    sums = rows.groupBy("p.term").agg(F.count_if(F.col("named") & F.col("p.pos").isNull()).alias("docs"), F.count("p.pos").alias("places"), F.sum("p.pos").alias("at"))
    again = stored(df.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.count("*").alias("n")).filter("n > 1").select("id"), "repeated-ids")
    if again.isEmpty():
        return sums
    pairs = own.join(again, "id", "left_semi").select("id", F.explode(F.array_distinct(F.array_compact("terms"))).alias("term"))
    surplus = pairs.groupBy("id", "term").agg((F.count("*") - 1).alias("n")).groupBy("term").agg(F.sum("n").alias("surplus"))
    return sums.join(surplus, "term", "left").select("term", (F.col("docs") - F.coalesce("surplus", F.lit(0))).alias("docs"), "places", "at")


def parse_clauses(queries: DataFrame) -> DataFrame:
    """(qid, branch, negative, words): web syntax, where "or" parts branches, quotes hold phrases, a dash negates."""
    parts = F.regexp_extract_all(F.lower("q"), F.lit(r'(-?"[^"]*"|\S+)'), 1)
    flat = queries.select("qid", F.posexplode(parts).alias("at", "part"))
    branch = F.sum((F.col("part") == "or").cast("int")).over(Window.partitionBy("qid").orderBy("at"))
    clauses = flat.withColumn("branch", branch).filter("part != 'or'").select("qid", "branch", F.col("at").alias("clause"), F.col("part").startswith("-").alias("negative"), tokens(F.col("part")).alias("all"))
    return clauses.withColumn("words", F.filter("all", lambda w: ~w.isin(*STOP_WORDS))).filter(F.size("words") > 0).drop("all")


def web_search(index: DataFrame | StoredIndex, queries: DataFrame, stemmed: bool = False) -> DataFrame:
    """(qid, id) of documents that match: all clauses of some branch, none of its negated ones.

    ``queries`` are (qid, q) in web syntax, or a table of clauses as ``parse_clauses`` gives. ``stemmed`` says how the
    index was built: the queries' words are then stemmed too. A stored index serves both and is read by their words.

    A clause's words join the index by term; a phrase needs its words in one field at consecutive places, found as
    starts that all words agree on. A branch matches where its number of positive clauses does.
    """
    clauses = queries if "words" in queries.columns else parse_clauses(queries)
    words = clauses.select("qid", "branch", "clause", "negative", F.size("words").alias("size"), F.posexplode("words").alias("nth", "term"))
    if isinstance(index, StoredIndex):
        index = index.lookup(words, stemmed)
    words = words.withColumn("term", stem(F.col("term"))) if stemmed else words
    hits = words.join(index, "term").select("qid", "branch", "clause", "negative", "size", "id", "weight", (F.col("pos") - F.col("nth")).alias("start"), "nth")
    met = hits.groupBy("qid", "branch", "clause", "negative", "size", "id", "weight", "start").agg(F.countDistinct("nth").alias("n")).filter("n = size")
    met = met.select("qid", "branch", "clause", "negative", "id").distinct()
    need = clauses.filter("NOT negative").groupBy("qid", "branch").agg(F.count("*").alias("need"))
    both = met.groupBy("qid", "branch", "id").agg(F.count_if(~F.col("negative")).alias("n"), F.count_if("negative").alias("against"))  # the index is read once
    return both.filter("against = 0").join(need, ["qid", "branch"]).filter("n = need").select("qid", "id").distinct()


def search(feed: DataFrame, index: DataFrame | StoredIndex, text: DataFrame, filters: dict[str, list], number: int, size: int, stemmed: bool = True) -> dict[str, DataFrame]:
    """Text hits (by stem unless told otherwise), facet filters, order and one page, with facet counts under the text filter."""
    from .serve import apply_facets, facet_counts, page

    hits = feed.join(web_search(index, text, stemmed).select("id").distinct(), "id", "left_semi")
    return {"page": page(apply_facets(hits, filters), number, size), "facets": facet_counts(hits, filters, list(filters))}
