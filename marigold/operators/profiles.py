"""Profile records: names and aliases, characters, exports, embedding of what is pending, related lists and frontiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marigold.functions import text
from marigold.operators import search, store
from marigold.lineage import written

# Keys under which a payload hints at further searches, and the keys of a hint that is an object.
HINT_KEYS = ("hint", "hints", "suggestions", "suggested", "suggestedKeywords", "suggested_terms")
HINT_FIELDS = ("name", "title", "keyword", "key", "query", "text", "value")
CURSOR_KEYS = ("nextCursor", "next_cursor", "cursor")
LISTS = ("profiles", "recommendProfiles", "characters", "relatedProfiles")


def is_character(json: Column, relaxed: bool = True) -> Column:
    """Marked as a character; relaxed, also one that came from a character group or by a seed."""
    marked = F.coalesce(F.get_json_object(json, "$.isCharacter") == "true", F.lit(False))
    group = F.coalesce(F.get_json_object(json, "$._from_character_group") == "true", F.lit(False))
    return marked | group | F.get_json_object(json, "$._seed_id").isNotNull() if relaxed else marked


def export_profiles(raw: DataFrame, vectors: DataFrame, *, order: str, key: str = "cid", json_col: str = "payload") -> DataFrame:
    """(cid, pid, name, mbti, socionics, big5, has_vector): the last row of each cid, with whether it has a vector."""
    last = store.keep_last(raw, [key], [order])
    have = vectors.select(key).distinct().withColumn("has_vector", F.lit(True))
    j, p = F.col(json_col), text.normalized_profile(F.col(json_col))
    rows = last.select(key, text.first_id(j).alias("pid"), text.pick_name(j).alias("name"), p["mbti"].alias("mbti"), p["socionics"].alias("socionics"), p["big5"].alias("big5"))
    return rows.join(have, key, "left").withColumn("has_vector", F.coalesce("has_vector", F.lit(False)))


def names_listing(df: DataFrame, *, id_col: str, name_col: str, contains: str | None = None, limit: int | None = None) -> DataFrame:
    """(id, name): names and aliases, each pair once."""
    listed = df.select(id_col, F.explode(text.aliases(F.col(name_col))).alias("name")).distinct()
    if contains:
        listed = listed.where(F.lower("name").contains(contains.lower()))
    return listed if limit is None else listed.orderBy("name", id_col).limit(limit)


def ids_by_name(df: DataFrame, name: str, *, id_col: str, name_col: str, limit: int = 20) -> DataFrame:
    """Ids of rows whose name or alias contains the text."""
    return search.alias_match(df, name_col, contains=name).select(id_col, name_col).orderBy(id_col).limit(limit)


def search_named(vectors: DataFrame, names: DataFrame, query: Sequence[float], k: int, *, id_col: str, name_col: str, contains: str | None = None, regex: str | None = None, vector_col: str = "embedding") -> DataFrame:
    """(id, name, score): nearest rows among those whose names match. The filter comes before the top-k, so k rows come if k match."""
    matched = search.alias_match(names, name_col, contains=contains, regex=regex) if contains or regex else names
    return search.cosine_topk(vectors.join(matched.select(id_col, name_col), id_col), query, k, id_col=id_col, vector_col=vector_col).select(id_col, name_col, "score")


def refresh_names(ids: DataFrame, characters: DataFrame, payloads: DataFrame, key: str = "cid") -> DataFrame:
    """(cid, name): the character's name, else the payload's, else "(unknown)"."""
    c = characters.groupBy(key).agg(F.min("name").alias("_c"))
    p = payloads.groupBy(key).agg(F.min("name").alias("_p"))
    return ids.join(c, key, "left").join(p, key, "left").select(key, F.coalesce("_c", "_p", F.lit("(unknown)")).alias("name"))


def embed_pending(profiles: DataFrame, vectors: DataFrame, columns: Sequence[str], key: str = "cid") -> DataFrame:
    """(cid, vector): hash embeddings of the joined text columns for profiles that have no vector yet."""
    pending = store.missing(profiles, vectors, [key]).select(key, F.concat_ws(" | ", *columns).alias("_text"))
    return search.hash_embeddings(pending, id_col=key, text_col="_text")


def field_values(df: DataFrame, columns: Sequence[str], top: int = 10) -> DataFrame:
    """(field, value, n): the most frequent values of each field."""
    from pyspark.sql import Window

    cells = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns))).alias("x")).select("x.*").where("value IS NOT NULL AND value <> ''")
    w = Window.partitionBy("field").orderBy(F.desc("n"), "value")
    return cells.groupBy("field", "value").agg(F.count("*").alias("n")).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top).drop("_r")


def manifest(profiles: DataFrame, vectors: DataFrame, *, key: str, vector_col: str) -> DataFrame:
    """(n_profiles, n_vectors, n_both, dimension): what an export holds."""
    both = profiles.select(key).distinct().join(vectors.select(key).distinct(), key, "left_semi").agg(F.count("*").alias("n_both"))
    v = vectors.agg(F.count("*").alias("n_vectors"), F.max(F.size(vector_col)).alias("dimension"))
    return profiles.agg(F.count("*").alias("n_profiles")).join(v).join(both).select("n_profiles", "n_vectors", "n_both", "dimension")


def manifest_with_variance(profiles: DataFrame, vectors: DataFrame, *, key: str, vector_col: str, components: int = 3) -> DataFrame:
    """The manifest, and the share of variance that each principal component of the vectors explains."""
    from marigold.operators import ml

    _, fitted = ml.fit_pca(vectors, components, vector_col=vector_col, id_col=key)
    return manifest(profiles, vectors, key=key, vector_col=vector_col).withColumn("variance", F.array(*(F.lit(x) for x in fitted.explained)))


def related_items(json: Column, lists: Sequence[str] = LISTS) -> Column:
    """Array of struct(list, item): objects of the named lists of a payload, as JSON text; absent lists give none."""

    def listed(key: str) -> Column:
        items = F.coalesce(F.from_json(F.get_json_object(json, f"$.{key}"), "array<string>"), F.array().cast("array<string>"))
        return F.transform(items, lambda x: F.struct(F.lit(key).alias("list"), x.alias("item")))

    parts = [listed(k) for k in sorted(lists)]
    return F.filter(F.concat(*parts), lambda x: x["item"].startswith("{"))


def related_edges(payloads: DataFrame, *, seed_col: str, json_col: str, lists: Sequence[str] = LISTS) -> DataFrame:
    """(from_pid, to_pid, relation, source): an edge from the seed to each related item that has an id, each once."""
    items = payloads.select(F.col(seed_col).alias("from_pid"), F.explode(related_items(F.col(json_col), lists)).alias("x"))
    edges = items.select("from_pid", text.first_id(F.col("x.item")).alias("to_pid"), F.col("x.list").alias("relation"), F.concat(F.lit("related:"), F.col("x.list")).alias("source"))
    return edges.where("to_pid IS NOT NULL").dropDuplicates(["from_pid", "to_pid", "relation"])


def hints(json: Column, query: Column, most: int = 10) -> Column:
    """Further search terms of a payload, under six keys and as text, list of texts or list of objects; each once, not the query."""
    found = []
    for k in HINT_KEYS:
        value = F.get_json_object(json, f"$.{k}")
        listed = F.coalesce(F.when(value.startswith("["), F.from_json(value, "array<string>")), F.when(value.isNotNull(), F.array(value)), F.array().cast("array<string>"))
        found.append(F.transform(listed, lambda x: F.when(x.startswith("{"), text.json_text(x, *HINT_FIELDS)).otherwise(x)))
    terms = F.transform(F.array_compact(F.concat(*found)), lambda x: F.trim(x))
    return F.slice(F.array_distinct(F.filter(terms, lambda x: (x != "") & ~x.eqNullSafe(query))), 1, most)


def next_cursor(json: Column) -> Column:
    """The cursor of the next page under any of its spellings, as a number."""
    return F.coalesce(*(text.int_like(F.get_json_object(json, f"$.{k}")) for k in CURSOR_KEYS))


def profile_links(html: Column, base: str = "") -> Column:
    """Profile links of a page; without any, links made from sub-category ids that the page mentions."""
    links = F.array_distinct(F.regexp_extract_all(html, F.lit("href=[\"'](/profile[/?][^\"']+)[\"']"), F.lit(1)))
    ids = F.array_distinct(F.regexp_extract_all(html, F.lit(r"sub_cat_id\s*[:=]\s*(\d+)"), F.lit(1)))
    made = F.transform(ids, lambda i: F.concat(F.lit("/profile?sub_cat_id="), i))
    return F.transform(F.when(F.size(links) > 0, links).otherwise(made), lambda x: F.concat(F.lit(base), x))


def frontier(edges: DataFrame, seeds: DataFrame, depth: int, *, src: str = "from_pid", dst: str = "to_pid") -> DataFrame:
    """(node, level): nodes within `depth` steps of the seeds, with their distance. Each level is a written table."""
    reached = written(seeds.select(F.col(seeds.columns[0]).alias("node")).where("node IS NOT NULL").distinct().withColumn("level", F.lit(0)), "frontier")
    for level in range(1, depth + 1):
        last = reached.where(F.col("level") == level - 1).select(F.col("node").alias(src))
        new = edges.join(last, src, "left_semi").select(F.col(dst).alias("node")).where("node IS NOT NULL").distinct().join(reached, "node", "left_anti")
        step = written(new.withColumn("level", F.lit(level)), "frontier")
        if step.isEmpty():
            break
        reached = reached.unionByName(step)
    return reached


def has_access(roles: Column, allowed: Sequence[int], manages: Column) -> Column:
    """Any allowed role; where no roles are configured, the manage flag."""
    return F.arrays_overlap(roles, F.array(*(F.lit(r) for r in allowed))) if allowed else manages


def result_context(results: DataFrame) -> DataFrame:
    """(context): search results as one JSON list of their metadata, best first; results are top-k and so few."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("_o"), F.struct(*results.columns).alias("r"))))
    return results.agg(F.to_json(F.transform(ordered, lambda x: x["r"])).alias("context"))
