"""Queries on frames, segments and speaker vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from callflow.catalog.registry import query
from callflow.operators import frames, segments, speakers, spectral
from callflow.plans import diarize

ISLANDS = """SELECT call_id, run_idx, min(label) AS label, min(frame_idx) AS lo, max(frame_idx) AS hi FROM (SELECT *, sum(turn) OVER (PARTITION BY call_id ORDER BY frame_idx) AS run_idx
    FROM (SELECT *, CASE WHEN label = lag(label) OVER (PARTITION BY call_id ORDER BY frame_idx) THEN 0 ELSE 1 END AS turn FROM ({}) l) a) b GROUP BY call_id, run_idx"""


@query("e13_merge_segments", """SELECT call_id, min(speaker) AS speaker, min(start_ms) AS start_ms, arg_max(end_ms, seg_idx) AS end_ms FROM (SELECT *, sum(fresh) OVER (PARTITION BY call_id ORDER BY seg_idx) AS g FROM
    (SELECT *, CASE WHEN speaker = lag(speaker) OVER w AND start_ms - lag(end_ms) OVER w <= 500 THEN 0 ELSE 1 END AS fresh FROM segs WINDOW w AS (PARTITION BY call_id ORDER BY seg_idx)) a) b GROUP BY call_id, g""", "segments",
    segs="SELECT call_id, seg_idx, start_ms, end_ms, CASE WHEN speaker = 'speaker_2' THEN speaker ELSE 'speaker_0' END AS speaker FROM segments")
def e13(t):
    segs = t["segments"].withColumn("speaker", F.when(F.col("speaker") == "speaker_2", F.col("speaker")).otherwise("speaker_0"))
    return segments.merge_adjacent(segs).select("call_id", "speaker", "start_ms", "end_ms")





def quiet(t):
    """Frames scaled so that the speech threshold splits them evenly."""
    return t["frames"].withColumn("speech_prob", F.col("speech_prob") * 5)


@query("e14_speech_segments", f"SELECT call_id, 20 * lo AS start_ms, 20 * (hi + 1) AS end_ms FROM ({ISLANDS.format('SELECT call_id, frame_idx, CASE WHEN speech_prob * 5 > 0.5 THEN 1 ELSE 0 END AS label FROM frames')}) r WHERE label = 1 AND hi - lo + 1 >= 10", "frames")
def e14(t):
    return segments.speech_segments(quiet(t))


@query("e15_label_segments", """SELECT call_id, 'speaker_' || CAST(min(label) AS VARCHAR) AS speaker, min(seg_idx) * 500 AS start_ms, max(seg_idx) * 500 + 1000 AS end_ms FROM (SELECT *, sum(turn) OVER (PARTITION BY call_id ORDER BY seg_idx) AS g
    FROM (SELECT *, CASE WHEN label = lag(label) OVER (PARTITION BY call_id ORDER BY seg_idx) THEN 0 ELSE 1 END AS turn FROM (SELECT call_id, frame_idx AS seg_idx, CAST(floor(speech_prob * 20) AS BIGINT) % 3 AS label FROM frames) x) a) b GROUP BY call_id, g""", "frames")
def e15(t):
    wins = t["frames"].select("call_id", F.col("frame_idx").alias("win_idx"), (F.floor(F.col("speech_prob") * 20) % 3).alias("label"), (F.col("frame_idx") * 500).alias("start_ms"), (F.col("frame_idx") * 500 + 1000).alias("end_ms"))
    return segments.label_segments(wins).select("call_id", "speaker", "start_ms", "end_ms")


@query("e16_argmax_segments", f"""SELECT call_id, 'speaker_' || CAST(label AS VARCHAR) AS speaker, 100 * lo AS start_ms, 100 * (hi + 1) AS end_ms FROM ({ISLANDS.format("SELECT call_id, frame_idx, CASE WHEN p >= 0.5 AND p >= 0.6 - p THEN 0 WHEN 0.6 - p >= 0.5 THEN 1 ELSE -1 END AS label FROM (SELECT *, speech_prob * 4 AS p FROM frames) z")}) r WHERE label >= 0 AND hi - lo + 1 >= 2""", "frames")
def e16(t):
    p = F.col("speech_prob") * 4
    return segments.argmax_segments(t["frames"].withColumn("probs", F.array(p, F.lit(0.6) - p)), 100)


@query("e17_embedding_windows", """SELECT call_id, seg_idx, unnest(generate_series(0, n - 1)) AS win, start_ms + 500 * unnest(generate_series(0, n - 1)) AS start_ms, least(start_ms + 500 * unnest(generate_series(0, n - 1)) + 1000, end_ms) AS end_ms
    FROM (SELECT *, CAST(floor((end_ms - start_ms - 1000) / 500) + 1 + CASE WHEN (end_ms - start_ms) - 500 * (floor((end_ms - start_ms - 1000) / 500) + 1) >= 500 THEN 1 ELSE 0 END AS BIGINT) AS n FROM segments WHERE end_ms - start_ms >= 1000
    UNION ALL SELECT *, 1 FROM segments WHERE end_ms - start_ms < 1000 AND end_ms - start_ms >= 500) s""", "segments")
def e17(t):
    return segments.embedding_windows(t["segments"])


IVR_ENDS = "SELECT call_id, min(end_ms) AS end_ms FROM segments WHERE call_id % 2 = 0 GROUP BY call_id"


@query("e18_leading_ivr", f"""SELECT s.call_id, s.seg_idx, CASE WHEN f IS NULL THEN s.speaker ELSE 'speaker_' || CAST(dense_rank() OVER (PARTITION BY s.call_id ORDER BY s.speaker) - 1 AS VARCHAR) END AS speaker,
    CASE WHEN s.seg_idx = f AND s.start_ms < c THEN c ELSE s.start_ms END AS start_ms, s.end_ms FROM segments s LEFT JOIN
    (SELECT s.call_id, c, min(CASE WHEN s.end_ms > c THEN seg_idx END) AS f FROM segments s JOIN (SELECT call_id, least(end_ms + 500, 10000) AS c FROM ({IVR_ENDS}) i) k ON k.call_id = s.call_id GROUP BY s.call_id, c HAVING min(CASE WHEN s.end_ms > c THEN seg_idx END) > 0) m
    ON m.call_id = s.call_id WHERE f IS NULL OR s.seg_idx >= f""", "segments")
def e18(t):
    ivr = t["segments"].where("call_id % 2 = 0").groupBy("call_id").agg(F.min("end_ms").alias("end_ms"))
    return segments.remove_leading_ivr(t["segments"], ivr)


@query("e20_rolling_std", """SELECT call_id, frame_idx, round(CASE WHEN frame_idx >= 10 AND frame_idx <= last - 10 THEN sd ELSE 0 END, 6) AS energy_std FROM (SELECT call_id, frame_idx, max(frame_idx) OVER (PARTITION BY call_id) AS last,
    stddev_pop(speech_prob) OVER (PARTITION BY call_id ORDER BY frame_idx ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING) AS sd FROM frames) t""", "frames")
def e20(t):
    return frames.rolling_std(t["frames"], "speech_prob").select("call_id", "frame_idx", F.round("energy_std", 6).alias("energy_std"))


FEATURES = """SELECT call_id, frame_idx, 250 * frame_idx AS t_ms, CASE WHEN frame_idx % 60 < 14 THEN 0.001 ELSE 0.2 + speech_prob END AS energy_std, CASE WHEN frame_idx % 60 < 14 THEN 5 + speech_prob ELSE speech_prob END AS dtmf,
    CASE WHEN frame_idx % 60 < 14 THEN 0.01 ELSE 0.9 + speech_prob / 10 END AS flatness, speech_prob AS high_freq, CASE WHEN frame_idx % 60 < 14 THEN 0.9 ELSE 0.1 END AS zcr, 0.05 AS rms, CASE WHEN call_id % 5 = 0 THEN 0.5 ELSE 0.005 END AS std FROM frames"""
STATS = "SELECT call_id, " + ", ".join(f"avg({m}) AS m_{m}, stddev_pop({m}) AS d_{m}" for m in frames.METRICS) + ", max(t_ms) AS total, max(frame_idx) AS last FROM feats GROUP BY call_id"
Z = "SELECT f.*, s.total, s.last, " + ", ".join(f"CASE WHEN d_{m} < 1e-10 THEN 0 ELSE ({m} - m_{m}) / d_{m} END AS z_{m}" for m in frames.METRICS) + " FROM feats f JOIN stats s ON s.call_id = f.call_id"
NS = {
    "feats": FEATURES, "stats": STATS, "z": Z,
    "raw": """SELECT *, CASE WHEN (z_dtmf > 2 AND z_flatness < -1.5 AND z_zcr > 2) OR (z_flatness < -1.5 AND z_energy_std < -1) OR (t_ms < least(15000.0, total * 0.25) AND
       CAST(z_flatness < -1.5 AS INT) + CAST(z_energy_std < -1 AS INT) + CAST(z_zcr > 2 AS INT) + CAST(z_high_freq > 2 AS INT) >= 3) THEN 1 ELSE 0 END AS raw FROM z""",
    "kept": """SELECT *, CASE WHEN raw = 1 AND (frame_idx < 10 OR frame_idx > last - 10 OR sum(raw) OVER (PARTITION BY call_id ORDER BY frame_idx ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING) >= 10) THEN 1 ELSE 0 END AS label FROM raw""",
}


@query("e19_non_speech_frames", "SELECT call_id, frame_idx, label AS non_speech FROM kept", "frames", **NS)
def e19f(t):
    t["frames"].createOrReplaceTempView("frames")
    return frames.flag_frames(t.spark.sql(FEATURES)).select("call_id", "frame_idx", "non_speech")


@query("e19_non_speech", f"""SELECT r.call_id, 250 * lo AS start_ms, CASE WHEN hi = last THEN 250 * hi ELSE 250 * (hi + 1) END AS end_ms FROM ({ISLANDS.format('SELECT * FROM kept')}) r JOIN stats s ON s.call_id = r.call_id
    WHERE label = 1 AND CASE WHEN hi = last THEN 250 * hi ELSE 250 * (hi + 1) END - 250 * lo > 1000 AND r.call_id % 5 <> 0""", "frames", **NS)
def e19(t):
    t["frames"].createOrReplaceTempView("frames")
    return frames.non_speech_segments(t.spark.sql(FEATURES))


@query(
    "e21_chunk_plan",
    """SELECT call_id, k AS chunk_idx, s AS start_ms, CASE WHEN cut IS NULL THEN total ELSE least(cut + 200, total) END AS end_ms FROM walk""",
    "frames",
    quiet="SELECT call_id, list(30 * frame_idx ORDER BY frame_idx) FILTER (WHERE speech_prob * 5 <= 0.5) AS sil, 30 * (max(frame_idx) + 1) AS total FROM frames GROUP BY call_id",
    walk="""SELECT call_id, sil, total, 0 AS k, CAST(0 AS BIGINT) AS s, CASE WHEN 600 >= total THEN NULL ELSE coalesce(list_sort(list_transform(list_filter(sil, lambda x: x BETWEEN 450 AND least(total, 750)), lambda x: abs(x - 600) * 100000000 + x))[1] % 100000000, 600) END AS cut FROM quiet
       UNION ALL SELECT call_id, sil, total, k + 1, cut, CASE WHEN cut + 600 >= total THEN NULL ELSE coalesce(list_sort(list_transform(list_filter(sil, lambda x: x BETWEEN cut + 450 AND least(total, cut + 750)), lambda x: abs(x - cut - 600) * 100000000 + x))[1] % 100000000, cut + 600) END FROM walk WHERE cut IS NOT NULL""",
)
def e21(t):
    q = quiet(t)
    totals = q.groupBy("call_id").agg(((F.max("frame_idx") + 1) * 30).alias("total_ms"))
    return segments.plan_chunks(segments.silence_spans(q), totals, target_ms=600, drift_ms=150)


@query("c12_interval_subtraction", """SELECT call_id, a AS start_ms, b AS end_ms FROM (SELECT s.call_id, greatest(s.start_ms, coalesce(max(r.end_ms) OVER (PARTITION BY s.call_id, s.seg_idx ORDER BY r.start_ms, r.end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), s.start_ms)) AS a, r.start_ms AS b
      FROM segments s JOIN segments r ON r.call_id = s.call_id AND r.turn % 3 = 0 AND s.turn % 3 <> 0 AND r.start_ms < s.end_ms AND r.end_ms > s.start_ms) x WHERE b > a + 500
    UNION ALL SELECT call_id, f, e FROM (SELECT s.call_id, s.seg_idx, greatest(s.start_ms, coalesce(max(r.end_ms), 0)) AS f, s.end_ms AS e, count(r.turn) AS c FROM segments s LEFT JOIN segments r ON r.call_id = s.call_id AND r.turn % 3 = 0 AND r.start_ms < s.end_ms AND r.end_ms > s.start_ms WHERE s.turn % 3 <> 0 GROUP BY s.call_id, s.seg_idx, s.start_ms, s.end_ms) y WHERE c = 0 OR (f < e AND e - f >= 500)""", "segments")
def c12(t):
    s = t["segments"]
    return segments.subtract(s.where("turn % 3 <> 0"), s.where("turn % 3 = 0"))


UNIT = "SELECT call_id, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE))))) AS u FROM speaker_vectors"


@query("h24_l2_normalise", "SELECT call_id, vec_id, round(u[1], 6) AS first_value, round(list_sum(u), 6) AS total FROM unit", "speaker_vectors", unit=UNIT)
def h24(t):
    u = t["speaker_vectors"].select("call_id", "vec_id", speakers.normalise(F.col("embedding")).alias("u"))
    return u.select("call_id", "vec_id", F.round(F.col("u")[0], 6).alias("first_value"), F.round(F.aggregate("u", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("c13_affinity_degree", "SELECT a.call_id, a.vec_id, round(sum(CASE WHEN a.vec_id = b.vec_id THEN 1 ELSE (list_dot_product(a.u, b.u) + 1) / 2 END), 4) AS degree, count(*) AS n_vectors FROM unit a JOIN unit b ON a.call_id = b.call_id GROUP BY a.call_id, a.vec_id", "speaker_vectors", unit=UNIT)
def c13(t):
    return speakers.affinity_degree(t["speaker_vectors"]).withColumn("degree", F.round("degree", 4))


@query("c13_pair_affinity", "SELECT a.call_id, a.vec_id AS left_id, b.vec_id AS right_id, round((list_dot_product(a.u, b.u) + 1) / 2, 6) AS affinity FROM unit a JOIN unit b ON a.call_id = b.call_id AND b.vec_id = a.vec_id + 1", "speaker_vectors", unit=UNIT)
def c13_pairs(t):
    v = t["speaker_vectors"]
    nxt = v.select("call_id", F.col("vec_id").alias("left_id"), (F.col("vec_id") + 1).alias("right_id"))
    return speakers.pair_affinity(v, nxt).withColumn("affinity", F.round("affinity", 6))


def quality_sql(labelled: str) -> dict[str, str]:
    """Silhouette, Davies–Bouldin and their mix per group of ``labelled`` (g, vec_id, c, u), from all pairs."""
    return {
        "pairs": f"SELECT a.g, a.vec_id, a.c AS ca, b.c AS cb, avg(CASE WHEN a.vec_id = b.vec_id THEN 0 ELSE (1 - list_dot_product(a.u, b.u)) / 2 END) AS d, count(*) AS n FROM {labelled} a JOIN {labelled} b ON a.g = b.g GROUP BY 1, 2, 3, 4",
        "sil": "SELECT g, avg(CASE WHEN n <= 1 THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette FROM (SELECT g, vec_id, max(CASE WHEN ca = cb THEN d * n / nullif(n - 1, 0) END) AS a, max(CASE WHEN ca = cb THEN n END) AS n, min(CASE WHEN ca <> cb THEN d END) AS b FROM pairs GROUP BY g, vec_id) t GROUP BY g",
        "flat": f"SELECT g, c, vec_id, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM {labelled}",
        "cen": "SELECT g, c, i, avg(x) AS m FROM flat GROUP BY g, c, i",
        "spr": "SELECT g, c, avg(d) AS s FROM (SELECT f.g, f.c, vec_id, sqrt(sum((x - m) * (x - m))) AS d FROM flat f JOIN cen ON cen.g = f.g AND cen.c = f.c AND cen.i = f.i GROUP BY f.g, f.c, vec_id) t GROUP BY g, c",
        "dbi": "SELECT g, avg(w) AS davies_bouldin, count(*) AS clusters FROM (SELECT m.g, a, max((sa.s + sb.s) / d) AS w FROM (SELECT p.g, p.c AS a, q.c AS b, sqrt(sum((p.m - q.m) * (p.m - q.m))) AS d FROM cen p JOIN cen q ON p.g = q.g AND p.i = q.i AND p.c <> q.c GROUP BY 1, 2, 3) m JOIN spr sa ON sa.g = m.g AND sa.c = a JOIN spr sb ON sb.g = m.g AND sb.c = b GROUP BY m.g, a) t GROUP BY g",
    }


@query("d18_cluster_quality", "SELECT g AS call_id, round(silhouette, 5) AS silhouette, round(davies_bouldin, 5) AS davies_bouldin, round(0.7 * silhouette + 0.3 / (1 + davies_bouldin), 5) AS combined FROM sil JOIN dbi USING (g)", "speaker_vectors",
    unit=UNIT, thirds="SELECT call_id AS g, vec_id, vec_id % 3 AS c, u FROM unit", **quality_sql("thirds"))
def d18(t):
    q = speakers.quality(t["speaker_vectors"].withColumn("cluster", F.col("vec_id") % 3), ["call_id"])
    return q.select("call_id", *[F.round(c, 5).alias(c) for c in ("silhouette", "davies_bouldin", "combined")])


@query("f7_best_cluster_count", """SELECT user_id, CASE WHEN k > 3 AND tried >= 3 AND best - coalesce(s3, 0) < 0.1 THEN 3 ELSE k END AS k, round(best, 6) AS score FROM (SELECT user_id, arg_max(k, row(s, -k)) AS k, max(s) AS best, max(CASE WHEN k = 3 THEN s END) AS s3, count(*) AS tried
    FROM (SELECT user_id, event_id % 6 + 2 AS k, max(value) / 400 AS s FROM events GROUP BY 1, 2) a GROUP BY user_id) b""")
def f7(t):
    scores = t["events"].groupBy("user_id", (F.col("event_id") % 6 + 2).alias("k")).agg((F.max("value") / 400).alias("score"))
    return speakers.best_count(scores, ["user_id"]).withColumn("score", F.round("score", 6))


def cluster_sql() -> dict[str, str]:
    """The clustering written out: seeds one after the other, then the fixed number of rounds, for every count."""
    out = {"unit": UNIT, "coord": "SELECT call_id, vec_id, unnest(u) AS x, generate_subscripts(u, 1) AS p FROM unit", "seed1": "SELECT call_id, 1 AS i, arg_min(u, vec_id) AS u FROM unit GROUP BY call_id"}
    for i in range(2, max(speakers.COUNTS) + 1):
        out[f"seed{i}"] = f"""SELECT * FROM seed{i - 1} UNION ALL SELECT call_id, {i}, arg_min(u, near) FROM
            (SELECT a.call_id, a.vec_id, a.u, max(list_dot_product(a.u, s.u)) AS near FROM unit a JOIN seed{i - 1} s ON s.call_id = a.call_id GROUP BY 1, 2, 3) n GROUP BY call_id"""
    out["c0"] = f"SELECT k, call_id, i, u FROM seed{max(speakers.COUNTS)} JOIN (SELECT unnest({list(speakers.COUNTS)}) AS k) ks ON i <= k"
    for r in range(speakers.ROUNDS + 1):
        out[f"a{r}"] = f"SELECT k, a.call_id, vec_id, arg_max(i, list_dot_product(a.u, c.u)) AS i FROM unit a JOIN c{r} c ON c.call_id = a.call_id GROUP BY 1, 2, 3"
        if r < speakers.ROUNDS:
            out[f"v{r}"] = f"SELECT k, call_id, i, list(x ORDER BY p) AS v FROM (SELECT k, a.call_id, i, p, sum(x) AS x FROM a{r} a JOIN coord f ON f.call_id = a.call_id AND f.vec_id = a.vec_id GROUP BY 1, 2, 3, 4) s GROUP BY 1, 2, 3"
            out[f"c{r + 1}"] = f"""SELECT c.k, c.call_id, c.i, CASE WHEN v IS NULL THEN c.u ELSE list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) END AS u
                FROM c{r} c LEFT JOIN v{r} n ON n.k = c.k AND n.call_id = c.call_id AND n.i = c.i"""
    out["labelled"] = f"SELECT {{'k': k, 'call': a.call_id}} AS g, k, a.call_id, a.vec_id, i AS c, u FROM a{speakers.ROUNDS} a JOIN unit n ON n.call_id = a.call_id AND n.vec_id = a.vec_id"
    out |= quality_sql("labelled")
    out["score"] = "SELECT g.call AS call_id, g.k AS k, 0.7 * silhouette + 0.3 / (1 + davies_bouldin) AS s FROM sil JOIN dbi USING (g) JOIN (SELECT call_id, count(*) AS n FROM unit GROUP BY call_id) z ON z.call_id = g.call WHERE clusters = g.k AND g.k < n AND n >= 4"
    out["best"] = "SELECT call_id, CASE WHEN k > 3 AND tried >= 3 AND top - coalesce(s3, 0) < 0.1 THEN 3 ELSE k END AS k FROM (SELECT call_id, arg_max(k, s) AS k, max(s) AS top, max(CASE WHEN k = 3 THEN s END) AS s3, count(*) AS tried FROM score GROUP BY call_id) b"
    return out


@query(
    "j9_speaker_clusters",
    "SELECT l.call_id, l.vec_id, dense_rank() OVER (PARTITION BY l.call_id ORDER BY c) - 1 AS speaker_no FROM labelled l LEFT JOIN best b ON b.call_id = l.call_id WHERE l.k = coalesce(b.k, 2)",
    "speaker_vectors",
    **cluster_sql(),
)
def j9(t):
    return speakers.cluster_calls(t["speaker_vectors"])


@query("j9_spectral_speakers")
def j9_spectral(t):
    return spectral.spectral_speakers(t["speaker_vectors"])


@query("k4_diarize_segments")
def k4(t):
    t["frames"].createOrReplaceTempView("frames")
    feats = t.spark.sql(FEATURES)
    vectors = t["embeddings"].select(F.col("vec_id").alias("_vec"), "embedding")
    held = t["embeddings"].agg(F.count(F.lit(1))).first()[0]  # one row

    def by_vectors(windows):
        # every window is heard as one of the given vectors
        heard = windows.withColumn("_vec", F.pmod(F.col("call_id") * 31 + F.col("win_idx"), F.lit(max(held, 1)))).join(vectors, "_vec")
        named = spectral.spectral_speakers(heard.select("call_id", F.col("win_idx").alias("vec_id"), "embedding"))
        return windows.join(named.select("call_id", F.col("vec_id").alias("win_idx"), F.col("speaker_no").alias("label")), ["call_id", "win_idx"])

    return diarize.diarize_segments(quiet(t), feats, by_vectors)
