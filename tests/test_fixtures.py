"""Hand-computed values and the edges of each operator family."""

from __future__ import annotations

import math
import time

import pytest
from pyspark.sql import functions as F

from marigold import registry
from marigold.functions import geometry, hashing, text, vectors
from marigold.operators import graph, ml, relational, search, stats, store
from marigold.plans import learning
from marigold.sources import readers, sinks
from marigold.streaming import messages


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_identifiers(spark):
    row = one(spark, hashing.cid_v1(F.lit('{"a":1,"b":2}')).alias("cid"), hashing.sha_bucket(F.lit("model")).alias("bucket"), hashing.fnv1a(F.lit("abc")).alias("fnv"))
    assert row.cid == "bafkreicdewgp66b744bw3csdam7ygcw7yyhmanzyerzvjcwhik4iqkjho4" and row.bucket == 36
    h = 2166136261
    for c in b"abc":
        h = (h ^ c) * 16777619 % 2**32
    assert row.fnv == h


def test_canonical_json(spark):
    rows = spark.createDataFrame([('{"b":2,"a":{"d":1,"c":[2,1]},"_source":"x"}',), ("[1, 2]",), ("no json",), (None,)], "j string").select(hashing.canonical_json("j").alias("c")).collect()
    assert [r.c for r in rows] == ['{"a":{"c":[2,1],"d":1},"b":2}', "[1,2]", None, None]


def test_profile_text(spark):
    row = one(
        spark,
        text.normalized_profile(F.lit('{"title":"T","bio":"B","mbti_type":"INTJ","attributes":{"socionics_type":"LII","big_five":"x"}}')).alias("p"),
        text.aliases(F.lit('Name "Nick" (Real) / Other')).alias("a"),
        text.display_name(F.lit("  DOE, JOHNNY ")).alias("d"),
        text.slug_name(F.lit("https://e.org/profile/johnny-doe-mbti-personality-type/12")).alias("s"),
        text.duration_seconds(F.lit("1h30m")).alias("t"),
        text.duration_seconds(F.lit("soon")).alias("t0"),
        text.first_id(F.lit('{"pid":"x7","id":"42"}')).alias("i"),
    )
    assert row.p.asDict() == {"name": "T", "description": "B", "mbti": "INTJ", "socionics": "LII", "big5": "x"}
    assert row.a[0] == 'Name "Nick" (Real) / Other' and {"Nick", "Real", "Other"} <= set(row.a)
    assert row.d == "Johnny DOE" and row.s == "Johnny Doe" and (row.t, row.t0) == (5400, 3600) and row.i == 42


def test_guardrails(spark):
    rows = spark.createDataFrame([("What type am I?",), ("Explain Model A structure",), ("a diagnosis? you are an ILE",)], "m string").select(text.guardrail_reasons(F.col("m")).alias("r"), text.redacted(F.col("m")).alias("x")).collect()
    assert [r.r for r in rows] == [["direct_type_request"], [], ["direct_type_request", "prohibited_topic"]]
    assert rows[0].x == "[REDACTED_FOR_GUARDRAIL]" and rows[1].x == "Explain Model A structure"


def test_confidence_and_k(spark):
    row = one(spark, *(text.vote_confidence(F.lit(v)).alias(f"v{v}") for v in (0, 50, 1000)))
    assert list(row) == [0.3, 0.5, 0.95] and [ml.suggest_k(n) for n in (1, 9, 100, 400)] == [3, 3, 10, 12]


def test_types_and_spheres(spark):
    codes = spark.createDataFrame([("INTj",), ("ILE",), ("lii",), ("xyz",), (None,)], "c string")
    assert [r.t for r in codes.select(geometry.normalized_type(F.col("c")).alias("t")).collect()] == ["INTJ", "ENTP", "INTP", None, None]
    assert codes.select(geometry.normalized_type(F.col("c"), strict=True).alias("t")).first().t == "INTP"
    every = spark.createDataFrame([(t,) for t in geometry.STACKS], "t string").withColumn("p", geometry.hopf(geometry.type_vector(F.col("t"))))
    moved = every.select("p", geometry.lat_lon(F.col("p")).alias("l"), geometry.function_offset(F.col("p"), F.col("t"), {"N": (0.0, 1.0, 0.0), "F": (1.0, 0.0, 0.0)}).alias("m")).collect()
    for r in moved:
        assert math.isclose(sum(x * x for x in r.p), 1) and -90 <= r.l.lat <= 90 and math.isclose(sum(x * x for x in r.m), 1)
        assert math.acos(max(-1, min(1, sum(a * b for a, b in zip(r.p, r.m, strict=True))))) <= math.radians(12) + 1e-9


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 0.0]), (4, None)], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in search.cosine_topk(df, [0.0, 0.0], 9).collect()] == [(1, 0.0), (2, 0.0), (3, 0.0)]
    assert [(r.vec_id, r.score) for r in search.cosine_topk(df, [2.0, 0.0], 2).collect()] == [(1, 1.0), (3, 1.0)]
    assert [r.vec_id for r in search.similar(df, df.where("vec_id = 1"), 5).orderBy("rank").collect()] == [3, 2]
    ragged = spark.createDataFrame([([1.0, 2.0, float("nan")],), ([1.0, 2.0, 3.0],), ([1.0, 2.0],), ([1.0, 2.0, 3.0, 4.0],)], "embedding array<double>")
    assert stats.dimension_mode(ragged, "embedding").first().dimension == 3
    assert [r.embedding for r in ml.sanitize(ragged).collect()] == [[1, 2, 0], [1, 2, 3], [1, 2, 0], [1, 2, 3]]
    tied = spark.createDataFrame([([1.0] * n,) for n in (2, 2, 4, 4)], "embedding array<double>")
    assert (stats.dimension_mode(tied, "embedding").first().dimension, stats.dimension_mode(tied, "embedding", "smaller").first().dimension) == (4, 2)
    assert ml.sanitize(df.where("vec_id = 4")).count() == 0
    row = one(spark, vectors.cosine(F.array(F.lit(1.0), F.lit(1.0)), F.array(F.lit(1.0), F.lit(0.0))).alias("c"))
    assert math.isclose(row.c, math.sqrt(0.5), rel_tol=1e-6)


def test_embeddings_agree(spark):
    df = spark.createDataFrame([(1, "alpha beta beta"), (2, ""), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.vector for r in search.hash_embeddings(df).collect()}
    assert got[1] == pytest.approx(search.embed_text("alpha beta beta")) and got[2] == [0.0] * 64 and got[3] == [0.0] * 64


def test_keywords(spark):
    df = spark.createDataFrame([(101, "vector alpha beta"), (102, "gamma delta epsilon"), (3, "zeta"), (4, "zeta eta"), (5, None)], "doc_id long, text string")
    assert [r.doc_id for r in search.keyword_filter(df, ["zeta"]).collect()] == [3, 4] and search.keyword_filter(df, []).count() == 0
    assert [r.doc_id for r in search.hybrid(df, ["vector", "alpha"], "vector", 5).collect()] == [101]


def test_divergence(spark):
    df = spark.createDataFrame([("A", 1, 1), ("A", 1, 2), ("B", 1, 1), ("B", 1, 2), ("C", 1, None)], "type_label string, question_id int, answer_value int")
    got = {(r.type_a, r.type_b): r.jsd for r in stats.divergence_rank(df).collect()}
    assert got[("A", "B")] == 0 and set(got) == {("A", "B"), ("A", "C"), ("B", "C")} and all(0 <= x <= math.log(2) for x in got.values())
    with pytest.raises(ValueError):
        stats.distributions(df.drop("answer_value"))


def test_markov(spark):
    df = spark.createDataFrame([("s", "E", 1, True), ("t", "E", 1, False)], "session string, axis string, i int, up boolean")
    got = {r.session: (round(r.p_pos, 6), round(r.p_neg, 6)) for r in stats.markov_fold(df, ["session", "axis"], ["i"], F.col("up")).collect()}
    assert got == {"s": (0.625, 0.375), "t": (0.375, 0.625)}


def test_uniformity_and_health(spark):
    counts = spark.createDataFrame([("a",)] * 2 + [("b",)] * 4, "axis string")
    assert [stats.uniformity(counts, "axis", d).first().uniformity for d in (0, 1)] == [0.333333, 0.471405]
    p = spark.createDataFrame([("1", "n"), ("2", None)], "cid string, name string")
    v = spark.createDataFrame([(x,) for x in "13456"], "cid string")
    r = stats.health_report(p, v).first()
    assert (r.intersection, r.legacy_intersection, r.missing_names, r.vectors_without_profile) == (1, -2, 1, 4)


def test_store(spark):
    base = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "cid string, vector array<double>")
    same = store.upsert_counts(store.upsert(base, base, ["cid"], "vector")).first()
    assert (same.new, same.updated, same.same) == (0, 0, 2)
    batch = spark.createDataFrame([("c", "x", 1), ("c", "y", 2)], "cid string, payload string, i int")
    applied = store.upsert(spark.createDataFrame([], "cid string, payload string"), batch, ["cid"], "payload", ["i"]).collect()
    assert [(r.cid, r.payload, r.status) for r in applied] == [("c", "y", "new")]
    ids = spark.createDataFrame([(1,), (50,), (None,)], "message_id long")
    assert store.purge(ids, "message_id", [50]).count() == 2 and store.within_ids(ids, "message_id", []).count() == 0 and store.within_ids(ids, "message_id", None).count() == 3
    assert store.tag(ids, F.col("message_id") == 1, "k", "v", dry_run=True).columns == ["message_id"]
    assert store.expanded_queries(["a", "a"], ["b"], sweep=True)[:2] == [("a", False), ("a b", True)] and len(store.expanded_queries(["a"], [], True)) == 37


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 9), (7, 8), (None, 1)], "from_pid long, to_pid long")
    assert {r.node: r.component for r in graph.connected_components(edges).collect()} == {1: 1, 2: 1, 3: 1, 9: 9, 7: 7, 8: 7}
    assert graph.connected_components(edges.where("from_pid < 0")).count() == 0
    assert {r.pid: r.degree for r in graph.degrees(edges).collect()} == {1: 2, 2: 2, 3: 1, 9: 2, 7: 1, 8: 1}
    path = spark.createDataFrame([(i, i + 1) for i in range(200)], "from_pid long, to_pid long")
    assert graph.connected_components(path).where("component <> 0").count() == 0


def test_learning(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    projected, ratio = ml.pca(v, 3)
    values = [x for r in projected.collect() for x in r.projection]
    assert min(values) >= -1 and max(values) <= 1 and ratio == sorted(ratio, reverse=True) and 0 < sum(ratio) <= 1
    clustered, centres = ml.kmeans(v, 5)
    assert {r.cluster for r in clustered.select("cluster").distinct().collect()} <= set(range(5)) and len(centres) == 5
    assert ml.decimate(v, 10).count() == 10 and ml.reduce_near_duplicates(v, 0.1).count() <= v.count()


def test_silhouette_scan_tries_every_25th_k(spark, sf):
    rows = registry.queries()["kmeans_silhouette"](spark, sf).collect()
    assert [r.k for r in rows] == [50, 75, 100, 125, 150, 175, 200]
    assert [r.k for r in rows if r.best] == [max(rows, key=lambda r: r.silhouette).k]
    assert [learning.scanned_k(n) for n in (3, 100, 199, 300)] == [[2], [50], [50, 75], [50, 75, 100, 125, 150]]


def test_pager(spark):
    pages = spark.createDataFrame([("q", i, n) for i, n in enumerate((5, 0, 0, 0, 2))], "q string, page int, new int")
    assert stats.no_progress_stop(pages, keys=["q"], order="page", new_col="new", limit=3).count() == 4


def test_rate_limit(spark):
    calls = spark.createDataFrame([(1, i, float(t)) for i, t in enumerate((0, 10, 20, 30, 61))], "user_id long, call_id long, t double")
    assert [r.allowed for r in messages.rate_limited(calls, 3).orderBy("call_id").collect()] == [True, True, True, False, True]


def test_streams_give_the_batch_result(spark, tmp_path):
    calls = spark.createDataFrame([(u, 10 * i + u, float(7 * i)) for i in range(30) for u in (1, 2)], "user_id long, call_id long, t double")
    calls.repartition(1).write.parquet(str(tmp_path / "calls"))
    stream = spark.readStream.schema(calls.schema).parquet(str(tmp_path / "calls"))
    q = messages.rate_limited_stream(stream, 3).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("limited").collect())) == sorted(map(tuple, messages.rate_limited(calls, 3).collect()))
    chat = spark.createDataFrame([(1, 1, "a"), (1, 1, "a"), (1, 2, " "), (2, 1, "b"), (2, 2, None)], "channel_id long, message_id long, content string")
    chat.write.parquet(str(tmp_path / "chat"))
    messages.ingest(spark.readStream.schema(chat.schema).parquet(str(tmp_path / "chat")), str(tmp_path / "out"), str(tmp_path / "c2")).awaitTermination(120)
    assert sorted((r.channel_id, r.message_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, 1), (2, 1)]


def test_sources_and_sinks(spark, tmp_path):
    assert readers.parquet_or_empty(spark, str(tmp_path / "none"), "a int, b string").count() == 0
    path = str(tmp_path / "t.parquet")
    sinks.replace_parquet(spark.range(3), path)
    sinks.replace_parquet(spark.read.parquet(path).where("id > 0"), path)
    assert spark.read.parquet(path).count() == 2
    sinks.rotate(spark, path, str(tmp_path / "old.parquet"), spark.range(1).schema)
    assert spark.read.parquet(path).count() == 0 and spark.read.parquet(str(tmp_path / "old.parquet")).count() == 2
    df = spark.createDataFrame([(1, [1.0, 2.0], 'say "x", \n y')], "id long, v array<double>, s string")
    sinks.export(df, str(tmp_path / "c.csv"), "csv")
    row = readers.by_suffix(spark, str(tmp_path / "c.csv")).first()
    assert (row.id, row.v) == ("1", "[1.0,2.0]")
    sinks.export(df, str(tmp_path / "c.json"), "json")
    assert readers.by_suffix(spark, str(tmp_path / "c.json"), "id long, v array<double>").first().v == [1.0, 2.0]
    wide = spark.createDataFrame([tuple(range(9))], ", ".join(["uuid long", *(f"v{i} double" for i in range(8))])) if False else spark.range(1).select(F.lit("u").alias("uuid"), *(F.lit(float(i)).alias(f"v{i}") for i in range(10)))
    assert readers.vectors(wide).first().vector == [float(i) for i in range(10)]
    assert readers.vectors(spark.range(1).select(F.lit("[1,2]").alias("vector"), F.lit("c").alias("cid"))).first().vector == [1.0, 2.0]
    (tmp_path / "docs/sub").mkdir(parents=True)
    (tmp_path / "docs/sub/a.md").write_text("one\ntwo")
    (tmp_path / "docs/b.bin").write_text("x")
    assert [r.text for r in readers.documents(spark, str(tmp_path / "docs")).collect()] == ["one\ntwo"]
    sinks.audit(spark, str(tmp_path / "log"), "start", n=1)
    sinks.audit(spark, str(tmp_path / "log"), "stop", n=2)
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    (tmp_path / "bad.parquet").write_text("not parquet")
    assert readers.quarantine(spark, path, 1) is None
    assert readers.quarantine(spark, str(tmp_path / "bad.parquet"), int(time.time())) is not None
    with pytest.raises(Exception, match="does not exist"):
        readers.quarantine(spark, str(tmp_path / "absent.parquet"), 2)


def test_replace_parquet_puts_the_old_table_back(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t.parquet")
    sinks.replace_parquet(spark.range(3), path)
    real, calls = sinks._paths, []

    class Failing:
        def __init__(self, fs):
            self.fs = fs

        def rename(self, a, b):
            calls.append(str(b))
            return False if len(calls) == 2 else self.fs.rename(a, b)

    monkeypatch.setattr(sinks, "_paths", lambda spark, *names: (Failing(real(spark, *names)[0]), real(spark, *names)[1]))
    with pytest.raises(OSError, match="as it was"):
        sinks.replace_parquet(spark.range(9), path)
    assert len(calls) == 3 and spark.read.parquet(path).count() == 3


def test_lineage_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from marigold import lineage

    context = SimpleNamespace(master="spark://host:7077", getConf=lambda: {}, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False))))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        lineage.shared_dir(SimpleNamespace(sparkContext=context, conf={}))


def test_new_vectors_project_as_fitted_ones(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    projected, fitted = ml.fit_pca(v, 3)
    again = v.select("vec_id", fitted.of(F.col("embedding")).alias("again")).join(projected, "vec_id").collect()
    assert len(again) > 100 and all(abs(a - b) < 1e-9 for r in again for a, b in zip(r.again, r.projection, strict=True))
    assert 0 < sum(fitted.explained) < 1 and list(fitted.explained) == sorted(fitted.explained, reverse=True)
    far = spark.range(1).select(fitted.of(F.array(*(F.lit(1e6) for _ in fitted.mean))).alias("p"), fitted.of(F.array(F.lit(1.0))).alias("none")).first()
    assert all(-1 <= x <= 1 for x in far.p) and far.none is None


def test_reductions(spark, sf):
    assert [ml.reduced_k(n, 0.85) for n in (1, 3, 60, 1000, 10_000)] == [0, 1, 30, 50, 150]
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    twice = v.unionByName(v.withColumn("vec_id", F.col("vec_id") + 100_000))
    kept = ml.reduce_near_duplicates(twice, 0.85).select("vec_id").collect()
    assert 0 < len(kept) <= ml.reduced_k(twice.count(), 0.85)


def test_hash_buckets_of_any_dimension(spark):
    for d in (1, 7, 64, 256, 384, 1000, 2**31 - 1):
        row = spark.range(1).select(hashing.sha_bucket(F.lit("some wörd"), d).alias("b"), hashing.hashed_vectors(F.array(F.lit("some wörd")), "sha256", min(d, 1000)).alias("v")).first()
        import hashlib

        number = int(hashlib.sha256("some wörd".encode()).hexdigest(), 16)
        assert row.b == number % d and row.v[number % min(d, 1000)] == 1.0


def test_relational(spark):
    users = spark.createDataFrame([(1, "a", True), (2, "b", False)], "rater_id long, username string, is_active boolean")
    judged = spark.createDataFrame([], "rater_id long, judgment_id long, confidence double, entity_id long, session_id long, created_at timestamp")
    r = relational.rater_summary(users, judged).collect()
    assert [(x.rater_id, x.total_judgments, x.average_confidence) for x in r] == [(1, 0, None)]


def test_learning_against_numpy(spark, sf):
    import numpy as np

    rows = sorted(spark.read.parquet(f"{sf}/embeddings.parquet").collect(), key=lambda r: r.vec_id)
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)

    def fitted(a):
        mean = a.mean(0)
        _, s, v = np.linalg.svd(a - mean, full_matrices=False)
        v = v[:3] * np.sign(v[:3][np.arange(3), np.abs(v[:3]).argmax(1)])[:, None]
        p = (a - mean) @ v.T
        return mean, v, p.min(0), p.max(0), (s * s / (s * s).sum())[:3]

    def projected(a, mean, v, lo, hi, _):
        return np.clip(((a - mean) @ v.T - lo) / (hi - lo) * 2 - 1, -1, 1)

    values = lambda name: {r.vec_id: [r.p1, r.p2, r.p3] for r in registry.queries()[name](spark, sf).collect()}
    got = values("pca_top3")
    assert np.allclose([got[i] for i in ids.tolist()], projected(x, *fitted(x)), atol=1e-5)
    got, even = values("pca_new_vectors"), ids % 2 == 0
    assert np.allclose([got[i] for i in ids[~even].tolist()], projected(x[~even], *fitted(x[even])), atol=1e-5)
    assert np.allclose(registry.queries()["manifest_variance"](spark, sf).first().variance, fitted(x)[4], atol=1e-9)
    cluster = {r.vec_id: r.cluster for r in registry.queries()["kmeans_cosine"](spark, sf).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    own = np.array([cluster[i] for i in ids.tolist()])
    centres = np.array([u[own == c].mean(0) for c in range(own.max() + 1)])
    nearest = (u @ (centres / np.linalg.norm(centres, axis=1, keepdims=True)).T).argmax(1)
    assert (nearest == own).mean() > 0.9 and own.max() + 1 == ml.suggest_k(len(ids))
    profile = registry.queries()["kmeans_profile"](spark, sf).collect()
    assert sum(r.size for r in profile) == len(ids) and all(len(r.samples) == min(3, r.size) for r in profile)
    for name, most in (("dedup_cluster", len(ids)), ("decimate", 25)):
        kept = [r.vec_id for r in registry.queries()[name](spark, sf).collect()]
        assert 0 < len(kept) <= most and len(set(kept)) == len(kept) and set(kept) <= set(ids.tolist())
    moved = registry.queries()["function_offsets"](spark, sf).collect()
    assert all(abs(r.x**2 + r.y**2 + r.z**2 - 1) < 1e-5 for r in moved)
