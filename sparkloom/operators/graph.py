"""Typed relations between ideas: walks, detection, links between topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.vectors import cosine, doubles
from ..session import materialize, shared_dir
from .memory import overlaps, spans
from .nearest import within
from .ordering import lay_out, running

TYPES = ("supersedes", "builds_on", "contradicts", "answers", "relates_to")
#: Fixed value: what an unknown relation type counts as.
FALLBACK = "relates_to"


def clean_relations(relations: DataFrame, ideas: DataFrame) -> DataFrame:
    """(id, from_id, to_id, relation_type): relations between existing ideas, each triple once under its smallest id; a type
    outside the known ones becomes relates_to."""
    kind = F.when(F.col("relation_type").isin(*TYPES), F.col("relation_type")).otherwise(FALLBACK)
    known = ideas.select("id").distinct()
    rows = relations.groupBy("from_id", "to_id", kind.alias("relation_type")).agg(F.min("id").alias("id"))
    rows = rows.join(known.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(known.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    return rows.select("id", "from_id", "to_id", "relation_type")


def edges(relations: DataFrame, direction: str = "both") -> DataFrame:
    """(id, next): steps along relations, each once."""
    out = relations.select(F.col("from_id").alias("id"), F.col("to_id").alias("next"))
    back = relations.select(F.col("to_id").alias("id"), F.col("from_id").alias("next"))
    picked = {"out": out, "in": back, "both": out.unionByName(back)}[direction]
    return picked.where(F.col("id") != F.col("next")).distinct()


def walk(seeds: DataFrame, relations: DataFrame, hops: int, direction: str = "both", most: int | None = None) -> DataFrame:
    """(seed, id, hop, parent): what each seed reaches, at its first hop; of several ways the smallest parent stands.

    Breadth first: each hop joins the frontier with the steps and drops what the seed already has. The seed itself is hop 0.
    With `most`, a hop of a seed goes on with that many of the smallest ids.
    """
    steps = edges(relations, direction)
    base = shared_dir(seeds.sparkSession)
    frontier = seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("hop"), F.lit(None).cast("bigint").alias("parent")).distinct()
    seen, _ = materialize(frontier, f"{base}/hop=0")
    frontier, found = seen, seen
    for hop in range(1, hops + 1):
        fresh = frontier.join(steps, "id").groupBy("seed", F.col("next").alias("id")).agg(F.min("id").alias("parent"))
        fresh = fresh.join(found.select("seed", "id"), ["seed", "id"], "left_anti").select("seed", "id", F.lit(hop).alias("hop"), "parent")
        if most is not None:
            w = Window.partitionBy("seed").orderBy("id")
            fresh = fresh.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")
        frontier, got = materialize(fresh, f"{base}/hop={hop}", n=F.count("*"))
        if not got["n"]:
            break
        found = found.unionByName(frontier)
    return found


def paths(found: DataFrame) -> DataFrame:
    """(seed, id, hop, path): the ids from the seed on, of a walk()."""
    top = found.where("hop = 0").select("seed", "id", "hop", F.col("id").cast("string").alias("path"))
    out, level, hop = top, top, 0
    last = found.agg(F.max("hop")).first()[0] or 0
    while hop < last:
        hop += 1
        above = level.select("seed", F.col("id").alias("parent"), F.col("path").alias("above"))
        level = found.where(F.col("hop") == hop).join(above, ["seed", "parent"]).select("seed", "id", "hop", F.concat_ws("/", "above", F.col("id").cast("string")).alias("path"))
        out = out.unionByName(level)
    return out


def degrees(relations: DataFrame) -> DataFrame:
    """(id, outgoing, incoming, relation_type): relations of each idea by type."""
    rows = relations.select(F.col("from_id").alias("id"), "relation_type", F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(
        relations.select(F.col("to_id").alias("id"), "relation_type", F.lit(0).alias("o"), F.lit(1).alias("i"))
    )
    return rows.groupBy("id", "relation_type").agg(F.sum("o").alias("outgoing"), F.sum("i").alias("incoming"))


def detect(content: Column, intent: Column, other: Column, other_intent: Column, similarity: Column | None = None, threshold: float = 0.75) -> Column:
    """Types that relate a new statement to an earlier one: by markers and shared words, or by similarity where given."""
    answers = (intent == "solution") & other_intent.isin("question", "problem")
    if similarity is None:
        overlap = tx.content_overlap(content, other)
        found = F.array(
            F.when(tx.supersedes(content) & ((intent == other_intent) | overlap), "supersedes"), F.when(tx.builds_on(content) & overlap, "builds_on"), F.when(answers & overlap, "answers")
        )
        return F.array_compact(found)
    kind = F.when(answers, "answers").when(tx.supersedes(content), "supersedes").when(tx.builds_on(content), "builds_on").when(similarity > 0.85, "relates_to")
    return F.when(similarity >= threshold, F.array_compact(F.array(kind))).otherwise(F.array().cast("array<string>"))


def recent_pairs(ideas: DataFrame, most: int = 10) -> DataFrame:
    """(id, other_id, back): the ideas up to `most` places before each in its session, by time, then id."""
    rows = ideas.where(F.col("session").isNotNull()).select("session", "id", F.coalesce("message_time", "created_at").alias("at"))
    order = ["at", "id"]
    placed = running(lay_out(rows, ["session"], order), ["session"], order, sums={"place": F.lit(1)}).select("session", "id", "place")
    wanted = placed.select("session", "id", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("back"), "place").withColumn("place", F.col("place") - F.col("back"))
    other = placed.select("session", F.col("id").alias("other_id"), "place")
    return wanted.where("place > 0").join(other, ["session", "place"]).select("id", "other_id", "back")


def detected_relations(ideas: DataFrame, most: int = 10, by_vector: bool = False, threshold: float = 0.75) -> DataFrame:
    """(from_id, to_id, relation_type) between each idea and the `most` before it in its session.

    supersedes and builds_on go to the nearest earlier idea that fits, answers to all; by_vector compares embeddings instead.
    """
    pairs = recent_pairs(ideas, most)
    a = ideas.select("id", "content", "intent", *["embedding"] * by_vector)
    b = ideas.select(F.col("id").alias("other_id"), F.col("content").alias("other"), F.col("intent").alias("other_intent"), *[F.col("embedding").alias("other_v")] * by_vector)
    rows = pairs.join(a, "id").join(b, "other_id")
    similar = cosine(doubles(F.col("embedding")), doubles(F.col("other_v"))) if by_vector else None
    found = rows.select("id", "other_id", "back", F.explode(detect(F.col("content"), F.col("intent"), F.col("other"), F.col("other_intent"), similar, threshold)).alias("relation_type"))
    if by_vector:
        return found.select(F.col("id").alias("from_id"), F.col("other_id").alias("to_id"), "relation_type")
    w = Window.partitionBy("id", "relation_type").orderBy("back")
    nearest = found.withColumn("n", F.row_number().over(w)).where((F.col("n") == 1) | (F.col("relation_type") == "answers"))
    return nearest.select(F.col("id").alias("from_id"), F.col("other_id").alias("to_id"), "relation_type")


def topic_links(topic_vectors: DataFrame, topic_times: DataFrame, threshold: float, dim: int = 64) -> DataFrame:
    """(topic_id, related_topic_id, similarity, time_overlap): pairs of topics of at least this similarity, both ways.

    topic_vectors is (id, v), topic_times (id, first_seen, last_seen).
    """
    near = within(topic_vectors, topic_vectors, threshold, dim)
    a = topic_times.select(F.col("id").alias("query_id"), F.col("first_seen").alias("s1"), F.col("last_seen").alias("e1"))
    b = topic_times.select("id", F.col("first_seen").alias("s2"), F.col("last_seen").alias("e2"))
    meets = overlaps(F.col("s1"), F.col("e1"), F.col("s2"), F.col("e2"))
    return near.join(a, "query_id").join(b, "id").select(F.col("query_id").alias("topic_id"), F.col("id").alias("related_topic_id"), F.round("score", 6).alias("similarity"), meets.alias("time_overlap"))


def project_tree(projects: DataFrame, topics: DataFrame, span_rows: DataFrame) -> DataFrame:
    """(path, kind, id, name, depth): projects, their topics and the topics' spans; topics without project stand under 0."""
    t = topics.select("id", "name", F.coalesce("project_id", F.lit(0)).alias("project_id"))
    none = t.where("project_id = 0").select(F.lit(0).cast("bigint").alias("id"), F.lit("(Unassigned)").alias("name")).distinct()
    p = projects.select("id", "name").unionByName(none)
    s = spans(span_rows).select("id", "name", "topic_id").join(t.select(F.col("id").alias("topic_id"), "project_id"), "topic_id")
    text = lambda *c: F.concat_ws("/", *[F.col(x).cast("string") for x in c])
    return (
        p.select(text("id").alias("path"), F.lit("project").alias("kind"), "id", "name", F.lit(0).alias("depth"))
        .unionByName(t.select(text("project_id", "id").alias("path"), F.lit("topic").alias("kind"), "id", "name", F.lit(1).alias("depth")))
        .unionByName(s.select(text("project_id", "topic_id", "id").alias("path"), F.lit("span").alias("kind"), "id", "name", F.lit(2).alias("depth")))
    )


def among(relations: DataFrame, ideas: DataFrame) -> DataFrame:
    """The relations whose ends are both among the ideas."""
    ids = ideas.select("id").distinct()
    return relations.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi").select(relations.columns)


def neighbours(relations: DataFrame, most: int = 5) -> DataFrame:
    """(id, direction, relation_type, n, others): the related ideas of each idea by direction and type: their number, and the
    `most` smallest ids, joined with commas. Each pair counts once; a group is cut before it is gathered."""
    rows = relations.select(F.col("from_id").alias("id"), F.lit("out").alias("direction"), "relation_type", F.col("to_id").alias("other"))
    rows = rows.unionByName(relations.select(F.col("to_id").alias("id"), F.lit("in").alias("direction"), "relation_type", F.col("from_id").alias("other"))).distinct()
    by = ["id", "direction", "relation_type"]
    counts = rows.groupBy(*by).agg(F.count("*").alias("n"))
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("other"))).where(F.col("_n") <= most)
    others = F.array_join(F.array_sort(F.collect_list("other")).cast("array<string>"), ",").alias("others")
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("direction") == F.col("_d")) & F.col("relation_type").eqNullSafe(F.col("_t"))
    listed = first.groupBy(*by).agg(others).select(F.col("id").alias("_id"), F.col("direction").alias("_d"), F.col("relation_type").alias("_t"), "others")
    return counts.join(listed, same).select(*by, "n", "others")


def best_links(links: DataFrame, most: int = 3) -> DataFrame:
    """(topic_id, rank, related_topic_id, similarity): the `most` nearest of each topic's outgoing links."""
    w = Window.partitionBy("topic_id").orderBy(F.desc("similarity"), "related_topic_id")
    return links.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("topic_id", "rank", "related_topic_id", "similarity")


def executed_relations(proposed: DataFrame, ideas: DataFrame, known: DataFrame) -> DataFrame:
    """(from_id, to_id, relation_type): the proposed relations (source_file, from_line, to_id, type) that can be made and aren't
    known: the line names an idea, the smallest id if several, and the target exists. A missing type is 'related'; each once."""
    at = ideas.where("source_file IS NOT NULL AND source_line IS NOT NULL").groupBy("source_file", F.col("source_line").alias("from_line")).agg(F.min("id").alias("from_id"))
    made = proposed.join(at, ["source_file", "from_line"]).join(ideas.select(F.col("id").alias("to_id")), "to_id", "left_semi")
    rows = made.select("from_id", "to_id", F.coalesce("type", F.lit("related")).alias("relation_type")).distinct()
    return rows.join(known.select("from_id", "to_id", "relation_type").distinct(), ["from_id", "to_id", "relation_type"], "left_anti")


def link_topics(links: DataFrame, fresh: DataFrame) -> DataFrame:
    """links with those of fresh in place of or beside its own: one row for each (topic_id, related_topic_id), fresh ones first,
    then the greatest (similarity, link_type). Both have topic_id, related_topic_id, similarity, link_type."""
    cols = ["topic_id", "related_topic_id", "similarity", "link_type"]
    rows = links.select(*cols, F.lit(0).alias("_new")).unionByName(fresh.select(*cols, F.lit(1).alias("_new")))
    last = rows.groupBy("topic_id", "related_topic_id").agg(F.max(F.struct("_new", "similarity", "link_type")).alias("l"))
    return last.select("topic_id", "related_topic_id", "l.similarity", "l.link_type")
