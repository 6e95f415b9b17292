"""Keyword search, fusion of result lists, and searches composed of them.

A search takes a table of queries, so that one pass over the memory answers them all; a single query is a table of one row.
A result list is (query_id, rank, id, ...). Result lists are short; they join the memory's tables by id afterwards.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.observation import Observation

from ..functions.text import tokens
from ..session import materialize, shared_dir

#: Parameters of BM25 and of reciprocal rank fusion.
K1, B, LEAST_IDF, RRF = 1.2, 0.75, 1e-6, 60
#: Words of queries, each counted for every query, up to this many are broadcast (some 60 bytes each); more are joined by shuffle.
BROADCAST_TERMS = 100_000


def ranked(rows: DataFrame, k: int, *order) -> DataFrame:
    """The first k rows of each query, with their rank. Spark cuts each query's rows before the shuffle too."""
    w = Window.partitionBy("query_id").orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def bm25(queries: DataFrame, rows: DataFrame, k: int, mode: str = "or", only: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(query_id, rank, id, score): the k best rows of each query by BM25, ties by id.

    queries is (query_id, text), rows is (id, text). Words are runs of letters and digits in lower case; a query's words
    count once each. mode 'and' keeps rows with all of a query's words, `only` those hits (query_id, id) that it returns, both before the cut. Any text is a valid query; one without words finds
    nothing. Frequencies are counted for the queries' words only, before any shuffle, so frequent words are no hot keys.
    """
    spark = rows.sparkSession
    terms = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    wanted = terms.groupBy("query_id").agg(F.count("*").alias("wanted"))
    small = terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    hint = F.broadcast if small else (lambda df: df)
    bags = rows.where(F.col("id").isNotNull()).select("id", tokens(F.col("text")).alias("words")).withColumn("size", F.size("words"))
    # Number and length of the rows are seen while the postings are written: every text is split once.
    whole = Observation()
    bags = bags.observe(whole, F.count("*").alias("rows"), F.sum("size").alias("words"))
    # explode would have Catalyst filter on the words' number first, and so split every text twice.
    met = bags.select("id", "size", F.explode_outer("words").alias("term")).join(hint(terms.select("term").distinct()), "term").groupBy("id", "size", "term").agg(F.count("*").alias("tf"))
    posts, _ = materialize(met, f"{shared_dir(spark)}/posts")
    seen = whole.get
    every, mean = seen.get("rows") or 0, (seen.get("words") or 0) / (seen.get("rows") or 1) or 1.0
    df = posts.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.greatest(F.lit(LEAST_IDF), F.log((F.lit(every) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    weight = df.select("term", idf.alias("idf"))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.lit(mean)))
    # Where the words are broadcast, a row's postings stay together and so make its scores without a shuffle of their own. The
    # number is given, as postings are few and their scores many: by their size AQE would put them into one task.
    placed = posts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id") if small else posts
    hits = placed.join(hint(terms.join(weight, "term")), "term").groupBy("query_id", "id").agg(F.round(F.sum(part), 9).alias("score"), F.count("*").alias("met"))
    if mode == "and":
        hits = hits.join(wanted, "query_id").where("met = wanted")
    if only is not None:
        hits = only(hits)
    return ranked(hits.select("query_id", "id", "score"), k, F.desc("score"), "id").select("query_id", "rank", "id", "score")


def highlight(rows: DataFrame, terms: list[str], column: str = "content") -> DataFrame:
    """rows with the words in [brackets], in any case."""
    quoted = "|".join(rf"\Q{t}\E" for t in terms)
    return rows.withColumn(column, F.regexp_replace(column, rf"(?iu)(?<![\p{{L}}\p{{N}}])({quoted})(?![\p{{L}}\p{{N}}])", "[$1]") if terms else F.col(column))


def rrf(lists: list[DataFrame], k: int, boost: float = 1.0) -> DataFrame:
    """(query_id, rank, id, score, lists): fusion of result lists by the sum of 1 / (60 + rank); what more than one list has
    counts boost times."""
    every = None
    for one in lists:
        part = one.select("query_id", "id", (1.0 / (F.lit(RRF) + F.col("rank"))).alias("share"))
        every = part if every is None else every.unionByName(part)
    score = F.sum("share") * F.when(F.count("*") > 1, boost).otherwise(1.0)
    fused = every.groupBy("query_id", "id").agg(F.round(score, 9).alias("score"), F.count("*").alias("lists"))
    return ranked(fused, k, F.desc("score"), "id").select("query_id", "rank", "id", "score", "lists")


def both_first(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, id): what both lists have first, in a's order, then the rest of a, then of b."""
    rows = a.select("query_id", "id", F.lit(0).alias("list"), "rank").unionByName(b.select("query_id", "id", F.lit(1).alias("list"), "rank"))
    one = rows.groupBy("query_id", "id").agg(F.count("*").alias("n"), F.min(F.struct("list", "rank")).alias("first"))
    return ranked(one, k, F.desc("n"), F.col("first.list"), F.col("first.rank"), "id").select("query_id", "rank", "id")


def multi_search(lists: list[DataFrame], k: int) -> DataFrame:
    """(query_id, rank, id, strategy, distance): the union of strategies' lists (query_id, id, distance); the first strategy
    that has a row wins it; by distance, nulls last."""
    every = None
    for i, one in enumerate(lists):
        part = one.select("query_id", "id", F.lit(i).alias("strategy"), F.col("distance").cast("double").alias("distance"))
        every = part if every is None else every.unionByName(part)
    first = every.groupBy("query_id", "id").agg(F.min(F.struct("strategy", "distance")).alias("f")).select("query_id", "id", "f.strategy", "f.distance")
    return ranked(first, k, F.coalesce("distance", F.lit(999.0)), "id").select("query_id", "rank", "id", "strategy", "distance")


def research(vector: DataFrame, keyword: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, id, score, found): a vector list extended by a keyword list. score is the rank in the vector list,
    half less for what both have (of the better rank); the keyword list's own rows follow."""
    size = vector.groupBy("query_id").agg(F.max("rank").alias("size"))
    v, h = vector.select("query_id", "id", F.col("rank").alias("v")), keyword.select("query_id", "id", F.col("rank").alias("h"))
    rows = v.join(h, ["query_id", "id"], "full").join(size, "query_id", "left")
    score = F.when(F.col("v").isNotNull() & F.col("h").isNotNull(), F.least("v", "h") - 0.5).when(F.col("h").isNull(), F.col("v").cast("double")).otherwise(F.col("h") + F.coalesce("size", F.lit(0)).cast("double"))
    found = F.when(F.col("v").isNotNull() & F.col("h").isNotNull(), "both").when(F.col("h").isNull(), "vector").otherwise("keyword")
    return ranked(rows.select("query_id", "id", score.alias("score"), found.alias("found")), k, "score", "id").select("query_id", "rank", "id", "score", "found")


def further(found: DataFrame, similar: DataFrame, most: int = 3) -> DataFrame:
    """(query_id, rank, id, score, found, similar_to): a result list of research(), then the rows of similar (query_id: an id,
    rank, id) that the list's first `most` rows lead to and that it lacks, each once, by the row that leads to it first."""
    led = found.where(F.col("rank") <= most).select("query_id", F.col("rank").alias("of"), F.col("id").alias("seed"))
    after = led.join(similar.select(F.col("query_id").alias("seed"), "rank", "id"), "seed").join(found.select("query_id", "id"), ["query_id", "id"], "left_anti")
    once = after.groupBy("query_id", "id").agg(F.min(F.struct("of", "rank", "seed")).alias("first"))
    size = found.groupBy("query_id").agg(F.max("rank").alias("size"))
    placed = ranked(once, 1 << 30, "first.of", "first.rank", "id").join(size, "query_id")
    more = placed.select("query_id", (F.col("size") + F.col("rank")).alias("rank"), "id", F.lit(None).cast("double").alias("score"), F.lit("similar").alias("found"), F.col("first.seed").alias("similar_to"))
    return found.select("query_id", "rank", "id", "score", "found", F.lit(None).cast("bigint").alias("similar_to")).unionByName(more)


def report(found: DataFrame, rows: DataFrame, most: int = 10) -> DataFrame:
    """(query_id, ideas, sessions, topics, kinds): of each result list the number of rows, of their sessions and topics, and how
    often each intent ('unknown' if null) is among the first `most`, the frequent first; rows is (id, session, topic_id, intent).

    A list's rows are few: their intents are counted within one row of the aggregate."""
    told = found.join(rows.select("id", "session", "topic_id", "intent"), "id")
    head = F.when(F.col("rank") <= most, F.coalesce("intent", F.lit("unknown")))
    one = told.groupBy("query_id").agg(F.count("*").alias("ideas"), F.countDistinct("session").alias("sessions"), F.countDistinct("topic_id").alias("topics"), F.collect_list(head).alias("of"))
    counted = F.transform(F.array_distinct("of"), lambda i: F.struct((-F.size(F.filter("of", lambda x: x == i))).alias("n"), i.alias("i")))
    lines = F.transform(F.array_sort(counted), lambda c: F.concat(c["i"], F.lit(": "), (-c["n"]).cast("string")))
    return one.select("query_id", "ideas", "sessions", "topics", F.array_join(lines, ", ").alias("kinds"))


def timeline(found: DataFrame, rows: DataFrame) -> DataFrame:
    """(query_id, date, ids): the rows of each result list by day, joined with commas in the list's order; rows is (id, at)."""
    told = found.join(rows.select("id", "at"), "id").where("at IS NOT NULL")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"].cast("string"))
    return told.groupBy("query_id", F.date_format("at", "yyyy-MM-dd").alias("date")).agg(F.array_join(listed, ",").alias("ids"))


def activation_rerank(hits: DataFrame, activation: DataFrame, weight: float = 0.3) -> DataFrame:
    """(query_id, rank, id, score): a result list again by (1 - w)(1 - i / n) + w * activation, i from 0."""
    n = F.count("*").over(Window.partitionBy("query_id"))
    base = hits.withColumn("base", 1 - (F.col("rank") - 1) / n)
    rows = base.join(activation.select("id", "activation"), "id", "left")
    score = (1 - weight) * F.col("base") + weight * F.coalesce("activation", F.lit(0.0))
    return ranked(rows.select("query_id", "id", F.round(score, 9).alias("score")), 1 << 30, F.desc("score"), "id").select("query_id", "rank", "id", "score")


def boost_active(hits: DataFrame, activation: DataFrame) -> DataFrame:
    """Distances of active rows (above 0.1) shortened by 0.3 times the activation, and the list in that order."""
    rows = hits.join(activation.select("id", "activation"), "id", "left")
    d = F.when(F.col("activation") > 0.1, F.greatest(F.lit(0.0), F.col("distance") * (1 - 0.3 * F.col("activation")))).otherwise(F.col("distance"))
    return ranked(rows.select("query_id", "id", F.round(d, 9).alias("distance")), 1 << 30, "distance", "id").select("query_id", "rank", "id", "distance")


def enrich_relations(ids: DataFrame, relations: DataFrame, most: int = 3) -> DataFrame:
    """(id, place, other_id, relation_type, direction): up to `most` related rows of each id, outgoing ones first."""
    edges = relations.select(F.col("from_id").alias("id"), F.col("to_id").alias("other_id"), "relation_type", F.lit("out").alias("direction"), F.col("id").alias("relation_id")).unionByName(
        relations.select(F.col("to_id").alias("id"), F.col("from_id").alias("other_id"), "relation_type", F.lit("in").alias("direction"), F.col("id").alias("relation_id"))
    )
    rows = edges.join(ids.select("id").distinct(), "id", "left_semi")
    w = Window.partitionBy("id").orderBy(F.desc("direction"), "relation_id")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("id", "place", "other_id", "relation_type", "direction")


def like_search(rows: DataFrame, part: str, k: int) -> DataFrame:
    """(id): the newest k rows whose content holds a text, in any case."""
    hit = F.contains(F.lower("content"), F.lower(F.lit(part)))
    return rows.where(hit).orderBy(F.desc_nulls_last("created_at"), F.desc("id")).limit(k).select("id")


def search_auto(asked: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, id, kind): a keyword search for each analysed question (query_id, kind, parts, intent, since, until),
    over rows (id, text, intent, at). All parts of all questions are one search.

    Intent and time narrow the hits before the cut. Both parts of a conjunction are fused, what both have counting half as
    much again; of a relation what both have comes first.
    """
    parts = asked.select("query_id", "kind", "intent", "since", "until", F.posexplode("parts").alias("part", "text")).withColumn("of", F.col("query_id") * 2 + F.col("part"))
    limits = parts.where("intent IS NOT NULL OR since IS NOT NULL").select(F.col("of").alias("query_id"), F.col("intent").alias("wanted"), "since", "until")

    def only(hits: DataFrame) -> DataFrame:
        narrowed = hits.join(limits, "query_id").join(rows.select("id", "intent", "at"), "id")
        fits = (F.col("wanted").isNull() | (F.col("intent") == F.col("wanted"))) & (F.col("since").isNull() | F.col("at").between(F.col("since"), F.col("until")))
        return hits.join(limits.select("query_id"), "query_id", "left_anti").unionByName(narrowed.where(fits).select(hits.columns))

    found = bm25(parts.select(F.col("of").alias("query_id"), "text"), rows.select("id", "text"), 2 * k, only=only)
    base = shared_dir(asked.sparkSession)
    lists, _ = materialize(found.withColumnRenamed("query_id", "of").join(parts.select("of", "query_id", "kind", "part"), "of").select("query_id", "kind", "part", "rank", "id"), f"{base}/lists")
    of = lambda kind, part: lists.where((F.col("kind") == kind) & (F.col("part") == part)).select("query_id", "rank", "id")
    both = rrf([of("conjunction", 0), of("conjunction", 1)], k, 1.5).select("query_id", "rank", "id", F.lit("conjunction").alias("kind"))
    related = both_first(of("relation", 0), of("relation", 1), k).select("query_id", "rank", "id", F.lit("relation").alias("kind"))
    rest = lists.where(F.col("kind").isin("simple", "intent_scoped") & (F.col("rank") <= k)).select("query_id", "rank", "id", "kind")
    return rest.unionByName(both).unionByName(related)
