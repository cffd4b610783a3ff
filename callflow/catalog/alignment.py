"""Queries on words, segments and chunks: alignment, runs, smoothing, lines."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callflow.catalog import views
from callflow.catalog.registry import query
from callflow.operators import align, lines, runs, smoothing
from callflow.plans import transcripts

views.SHARED.update(
    {
        # Words with restless labels and uneven pauses, so that every repair
        # rule has something to repair.
        "noisy_words": """
SELECT call_id, word_idx, text, start_ms, start_ms + 110 AS end_ms,
       CASE WHEN word_idx < 4 AND call_id % 4 = 0 THEN 'IVR'
            WHEN (word_idx * 7919 + call_id * 31) % 17 < 2 THEN 'speaker_' || CAST((block + 1) % speakers AS STRING)
            ELSE 'speaker_' || CAST(block % speakers AS STRING) END AS speaker
FROM (SELECT call_id, word_idx, text,
             120 * word_idx + 900 * CAST(floor(word_idx / 13) AS BIGINT) + 350 * CAST(floor(word_idx / 7) AS BIGINT) AS start_ms,
             CAST(floor(word_idx / (5 + call_id % 7)) AS BIGINT) AS block,
             CASE WHEN call_id % 3 = 0 THEN 3 ELSE 2 END AS speakers
      FROM words) t""",
        # Two calls of one speaker: one without any sentence end, one with few.
        "long_words": """
SELECT CASE WHEN call_id % 2 = 0 THEN 0 ELSE 1 END AS call_id, 10000 * call_id + word_idx AS word_idx,
       CASE WHEN call_id % 2 = 0 OR call_id % 10 > 1 THEN translate(text, '.?!', ';;;') ELSE text END AS text, 'speaker_0' AS speaker
FROM words""",
        "one_voice_words": """
SELECT call_id, word_idx, text, start_ms, end_ms, 'speaker_0' AS speaker FROM noisy_words""",
    }
)

views.DUCK.update(
    {
        "clipped": """
SELECT c.call_id, c.chunk_idx, s.seg_idx, s.speaker,
       greatest(0, s.start_ms - c.start_ms) AS start_ms, least(c.end_ms - c.start_ms, s.end_ms - c.start_ms) AS end_ms
FROM segments s JOIN chunks c ON s.call_id = c.call_id AND s.end_ms > c.start_ms AND s.start_ms < c.end_ms""",
        "scored": """
SELECT w.call_id, w.chunk_idx, w.pos, w.text, w.start_ms, w.end_ms, s.seg_idx, s.speaker,
       least(w.end_ms, s.end_ms) - greatest(w.start_ms, s.start_ms) AS ov,
       CASE WHEN w.start_ms + w.end_ms < 2 * s.start_ms THEN 2 * s.start_ms - w.start_ms - w.end_ms
            WHEN w.start_ms + w.end_ms > 2 * s.end_ms THEN w.start_ms + w.end_ms - 2 * s.end_ms ELSE 0 END / 2.0 AS dist
FROM chunk_words w LEFT JOIN clipped s ON w.call_id = s.call_id AND w.chunk_idx = s.chunk_idx""",
        "aligned_local": """
SELECT call_id, chunk_idx, pos, text, start_ms, end_ms,
       coalesce(max(CASE WHEN by_ov = 1 AND ov > 0 THEN speaker END), max(CASE WHEN by_dist = 1 THEN speaker END), 'speaker_0') AS speaker,
       max(CASE WHEN ov > 0 THEN ov END) AS overlap_ms,
       CASE WHEN max(ov) > 0 THEN NULL ELSE min(dist) END AS distance_ms,
       CASE WHEN max(ov) > 0 THEN 'overlap' WHEN max(seg_idx) IS NOT NULL THEN 'nearest' ELSE 'default' END AS how
FROM (SELECT *, row_number() OVER (PARTITION BY call_id, chunk_idx, pos ORDER BY CASE WHEN ov > 0 THEN ov END DESC NULLS LAST, seg_idx) AS by_ov,
             row_number() OVER (PARTITION BY call_id, chunk_idx, pos ORDER BY dist NULLS LAST, seg_idx) AS by_dist
      FROM scored) t
GROUP BY call_id, chunk_idx, pos, text, start_ms, end_ms""",
        "aligned": """
SELECT a.call_id, a.chunk_idx, row_number() OVER (PARTITION BY a.call_id ORDER BY a.chunk_idx, a.pos) - 1 AS word_idx,
       a.text, a.start_ms + c.start_ms AS start_ms, a.end_ms + c.start_ms AS end_ms, a.speaker, a.how
FROM aligned_local a JOIN chunks c ON a.call_id = c.call_id AND a.chunk_idx = c.chunk_idx""",
    }
)
views.NEEDS.update(
    {
        "noisy_words": ["words"],
        "long_words": ["words"],
        "one_voice_words": ["noisy_words"],
        "clipped": ["segments", "chunks"],
        "scored": ["chunk_words", "clipped"],
        "aligned_local": ["scored"],
        "aligned": ["aligned_local", "chunks"],
    }
)


def run_sql(source: str, name: str = "runs") -> str:
    """DuckDB text for the runs of ``source`` (call_id, word_idx, speaker, …)."""
    return f"""
SELECT call_id, run_idx, min(speaker) AS speaker, min(word_idx) AS first_idx, max(word_idx) AS last_idx,
       count(*) AS n_words, arg_min(start_ms, word_idx) AS start_ms, arg_max(end_ms, word_idx) AS end_ms,
       arg_max(text, word_idx) AS last_text
FROM (SELECT *, CAST(sum(turn) OVER (PARTITION BY call_id ORDER BY word_idx) AS BIGINT) AS run_idx
      FROM (SELECT *, CASE WHEN speaker = coalesce(lag(speaker) OVER (PARTITION BY call_id ORDER BY word_idx), speaker)
                           THEN 0 ELSE 1 END AS turn FROM {source}) a) b
GROUP BY call_id, run_idx"""


def merge_sql(source: str) -> str:
    """DuckDB text merging adjacent runs of ``source`` with equal speaker."""
    return f"""
SELECT call_id, g AS run_idx, min(speaker) AS speaker, min(first_idx) AS first_idx, max(last_idx) AS last_idx,
       CAST(sum(n_words) AS BIGINT) AS n_words, arg_min(start_ms, first_idx) AS start_ms,
       arg_max(end_ms, first_idx) AS end_ms, arg_max(last_text, first_idx) AS last_text
FROM (SELECT *, CAST(sum(turn) OVER (PARTITION BY call_id ORDER BY run_idx) AS BIGINT) AS g
      FROM (SELECT *, CASE WHEN speaker = coalesce(lag(speaker) OVER (PARTITION BY call_id ORDER BY run_idx), speaker)
                           THEN 0 ELSE 1 END AS turn FROM {source}) a) b
GROUP BY call_id, g"""


def totals_sql(source: str) -> str:
    return f"""
SELECT call_id, CAST(sum(n_words) AS BIGINT) AS call_words, count(*) AS call_runs,
       count(DISTINCT CASE WHEN speaker <> 'IVR' THEN speaker END) AS call_speakers
FROM {source} GROUP BY call_id"""


def near_sql(source: str) -> str:
    return f"""
SELECT r.*, t.call_words, t.call_runs, t.call_speakers,
       lag(speaker) OVER w AS prev_speaker, lead(speaker) OVER w AS next_speaker, lag(last_text) OVER w AS prev_text
FROM {source} r JOIN ({totals_sql(source)}) t ON r.call_id = t.call_id
WINDOW w AS (PARTITION BY r.call_id ORDER BY run_idx)"""


INTERIOR = "speaker <> 'IVR' AND prev_speaker <> 'IVR' AND next_speaker <> 'IVR'"


def smooth_sql(source: str) -> str:
    return f"""
SELECT call_id, run_idx, first_idx, last_idx, n_words, start_ms, end_ms, last_text,
       CASE WHEN {INTERIOR} AND prev_speaker = next_speaker AND call_words >= 3
             AND CASE WHEN call_speakers <= 2 THEN end_ms - start_ms < 500 ELSE end_ms - start_ms < 150 AND n_words <= 1 END
            THEN prev_speaker ELSE speaker END AS speaker
FROM ({near_sql(source)}) n"""


def boundary_sql(source: str) -> str:
    return f"""
SELECT call_id, run_idx, first_idx, last_idx, n_words, start_ms, end_ms, last_text,
       CASE WHEN ok AND prev_speaker IS NULL THEN next_speaker
            WHEN ok AND next_speaker IS NULL AND NOT (call_runs = 2 AND first_ok) THEN prev_speaker
            ELSE speaker END AS speaker
FROM (SELECT *, first_value(ok) OVER (PARTITION BY call_id ORDER BY run_idx) AS first_ok
      FROM (SELECT *, call_words >= 3 AND call_runs >= 2 AND call_speakers <= 2
                      AND n_words <= 2 AND end_ms - start_ms < 400 AS ok FROM ({near_sql(source)}) n) m) o"""


def sentence_sql(source: str) -> str:
    return f"""
SELECT call_id, run_idx, first_idx, last_idx, n_words, start_ms, end_ms, last_text,
       CASE WHEN {INTERIOR} AND call_words >= 5 AND n_words < 4 AND NOT regexp_matches(prev_text, '[.?!]\\s*$')
             AND (prev_speaker = next_speaker OR n_words <= 2) THEN prev_speaker ELSE speaker END AS speaker
FROM ({near_sql(source)}) n"""


def renumber_sql(source: str) -> str:
    return f"""
SELECT r.* EXCLUDE (speaker), coalesce(m.name, r.speaker) AS speaker,
       CASE WHEN m.name <> r.speaker THEN r.speaker END AS original_speaker
FROM {source} r LEFT JOIN (
  SELECT call_id, speaker, 'speaker_' || CAST(row_number() OVER (PARTITION BY call_id ORDER BY min(first_idx)) - 1 AS VARCHAR) AS name
  FROM {source} WHERE speaker <> 'IVR' GROUP BY call_id, speaker) m ON r.call_id = m.call_id AND r.speaker = m.speaker"""


# A word of a chunk without segments overlaps none: DuckDB's least and greatest skip nulls.
UNMATCHED = {"matched": views.DUCK["scored"], "scored": "SELECT * REPLACE (CASE WHEN seg_idx IS NOT NULL THEN ov END AS ov, CASE WHEN seg_idx IS NOT NULL THEN dist END AS dist) FROM matched"}
UNMATCHED["aligned_local"] = views.DUCK["aligned_local"]

RUN_COLS = "call_id, run_idx, speaker, first_idx, last_idx, n_words, start_ms, end_ms"
NOISY = {"runs": run_sql("noisy_words")}


@query("c1_segment_chunk_clip", "SELECT *, end_ms - start_ms AS duration_ms FROM clipped", "clipped")
def c1(t):
    return align.clip_segments(t["segments"], t["chunks"])


def aligned_local(t):
    return align.align_words(t["chunk_words"], align.clip_segments(t["segments"], t["chunks"]))


def aligned(t):
    return transcripts.align_corpus(t["chunk_words"], t["segments"], t["chunks"])


@query(
    "c2_word_align",
    "SELECT call_id, chunk_idx, pos, text, speaker, overlap_ms FROM aligned_local WHERE how = 'overlap'",
    "chunk_words clipped",
    **UNMATCHED,
)
def c2(t):
    return aligned_local(t).where("how = 'overlap'").select("call_id", "chunk_idx", "pos", "text", "speaker", "overlap_ms")


@query(
    "c3_nearest_segment",
    "SELECT call_id, chunk_idx, pos, text, speaker, distance_ms FROM aligned_local WHERE how = 'nearest'",
    "aligned_local",
)
def c3(t):
    return aligned_local(t).where("how = 'nearest'").select("call_id", "chunk_idx", "pos", "text", "speaker", "distance_ms")


@query(
    "c4_default_speaker",
    """SELECT w.call_id, w.chunk_idx, w.pos, 'speaker_0' AS speaker FROM chunk_words w
       WHERE NOT EXISTS (SELECT 1 FROM clipped s WHERE s.speaker = 'speaker_2' AND s.call_id = w.call_id AND s.chunk_idx = w.chunk_idx)""",
    "chunk_words clipped",
)
def c4(t):
    announcements = t["segments"].where("speaker = 'speaker_2'")
    got = align.align_words(t["chunk_words"], align.clip_segments(announcements, t["chunks"]))
    return got.where("how = 'default'").select("call_id", "chunk_idx", "pos", "speaker")


@query(
    "g1_concatenate_words",
    "SELECT call_id, chunk_idx, word_idx, text, start_ms, end_ms, speaker, how FROM aligned",
    "chunk_words clipped",
    **UNMATCHED,
    aligned=views.DUCK["aligned"],
)
def g1(t):
    return aligned(t).select("call_id", "chunk_idx", "word_idx", "text", "start_ms", "end_ms", "speaker", "how")


@query(
    "l1_dedupe_overlap",
    "SELECT call_id, word_idx, text, start_ms, end_ms FROM words",
    "words",
)
def l1(t):
    once = align.drop_repeated(t["chunk_words"], t["chunks"])
    return align.place_words(once, align.chunk_offsets(once, t["chunks"])).select(
        "call_id", F.col("spoken_idx").alias("word_idx"), "text", "start_ms", "end_ms"
    )


@query(
    "d1_speakers_per_call",
    """SELECT call_id, count(DISTINCT speaker) AS num_speakers, count(*) AS total_segments,
              string_agg(DISTINCT speaker, ',' ORDER BY speaker) AS speakers FROM segments GROUP BY call_id""",
    "segments",
)
def d1(t):
    return transcripts.speaker_sets(t["segments"])


@query(
    "d2_words_per_speaker",
    "SELECT call_id, speaker, count(*) AS n_words FROM aligned GROUP BY call_id, speaker",
    "aligned",
)
def d2(t):
    return aligned(t).groupBy("call_id", "speaker").agg(F.count(F.lit(1)).alias("n_words"))


@query(
    "d3_talk_time",
    "SELECT call_id, speaker, CAST(sum(end_ms - start_ms) AS BIGINT) AS talk_ms FROM segments GROUP BY call_id, speaker",
    "segments",
)
def d3(t):
    return transcripts.talk_time(t["segments"])


@query(
    "d4_dominant_speaker",
    """SELECT call_id, chunk_idx, arg_max(speaker, covered_ms * 1000000 - first_seg) AS speaker, max(covered_ms) AS covered_ms
       FROM (SELECT call_id, chunk_idx, speaker, CAST(sum(end_ms - start_ms) AS BIGINT) AS covered_ms, min(seg_idx) AS first_seg
             FROM clipped GROUP BY call_id, chunk_idx, speaker) t GROUP BY call_id, chunk_idx""",
    "clipped",
)
def d4(t):
    return align.dominant_speaker(align.clip_segments(t["segments"], t["chunks"]))


@query(
    "d5_raw_transcript",
    """SELECT call_id, string_agg(text, ' ' ORDER BY chunk_idx) AS raw_text
       FROM (SELECT call_id, chunk_idx, string_agg(text, ' ' ORDER BY pos) AS text FROM chunk_words GROUP BY call_id, chunk_idx) c
       GROUP BY call_id""",
    "chunk_words",
)
def d5(t):
    return lines.raw_transcript(transcripts.chunk_texts(t["chunk_words"]))


@query(
    "d6_call_metadata",
    """SELECT c.call_id, chunk_count, first_start_ms, last_end_ms, coalesce(num_speakers, 0) AS num_speakers,
              coalesce(total_segments, 0) AS total_segments
       FROM (SELECT call_id, count(*) AS chunk_count, min(start_ms) AS first_start_ms, max(end_ms) AS last_end_ms
             FROM chunks GROUP BY call_id) c
       LEFT JOIN (SELECT call_id, count(DISTINCT speaker) AS num_speakers, count(*) AS total_segments
                  FROM segments GROUP BY call_id) s ON c.call_id = s.call_id""",
    "chunks segments",
)
def d6(t):
    return transcripts.call_metadata(t["chunks"], t["segments"])


@query("e1_speaker_runs", f"SELECT {RUN_COLS} FROM runs", "aligned", runs=run_sql("aligned"))
def e1(t):
    return runs.speaker_runs(aligned(t), F.col("chunk_idx")).select(*RUN_COLS.split(", "))


@query(
    "e2_renumber_speakers",
    "SELECT call_id, run_idx, speaker, original_speaker FROM renamed",
    "noisy_words",
    **NOISY,
    renamed=renumber_sql("runs"),
)
def e2(t):
    return smoothing.renumber(runs.speaker_runs(t["noisy_words"])).select("call_id", "run_idx", "speaker", "original_speaker")


@query(
    "e3_single_speaker",
    """SELECT call_id, count(DISTINCT CASE WHEN speaker <> 'IVR' THEN speaker END) <= 1 AS single_speaker
       FROM noisy_words GROUP BY call_id""",
    "noisy_words",
)
def e3(t):
    return runs.call_totals(runs.speaker_runs(t["noisy_words"])).select(
        "call_id", (F.col("call_speakers") <= 1).alias("single_speaker")
    )


SILENCE_SQL = {
    "gaps": """SELECT *, start_ms - lag(end_ms) OVER (PARTITION BY call_id ORDER BY word_idx) AS gap,
       count(*) OVER (PARTITION BY call_id) AS n FROM one_voice_words""",
    "ordered": """SELECT call_id, list(gap ORDER BY gap) AS g FROM gaps WHERE gap > 0 GROUP BY call_id""",
    "high": """SELECT call_id, g, greatest(800, 3 * g[CAST(floor(len(g) / 2) AS BIGINT) + 1]) AS thr FROM ordered""",
    "limits": """SELECT call_id, CASE WHEN len(list_filter(g, lambda x: x >= thr)) >= 3 THEN thr
       ELSE greatest(300, g[CAST(floor(len(g) * 0.75) AS BIGINT) + 1]) END AS thr FROM high""",
    "stretches": """SELECT g.*, CAST(sum(CASE WHEN gap >= thr THEN 1 ELSE 0 END) OVER (PARTITION BY g.call_id ORDER BY word_idx) AS BIGINT) AS st
       FROM gaps g LEFT JOIN limits l ON g.call_id = l.call_id""",
    "turns": """SELECT call_id, st, CAST(sum(CASE WHEN st > 0 AND c >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY call_id ORDER BY st) AS BIGINT) AS turn,
       max(st) OVER (PARTITION BY call_id) AS last_st
       FROM (SELECT call_id, st, count(*) AS c FROM stretches GROUP BY call_id, st) t""",
}


@query(
    "e4_silence_split",
    """SELECT s.call_id, s.word_idx,
              CASE WHEN n >= 5 AND last_st > 0 THEN 'speaker_' || CAST(turn % 2 AS VARCHAR) ELSE s.speaker END AS speaker
       FROM stretches s JOIN turns t ON s.call_id = t.call_id AND s.st = t.st""",
    "one_voice_words",
    **SILENCE_SQL,
)
def e4(t):
    return smoothing.split_by_silence(t["one_voice_words"]).select("call_id", "word_idx", "speaker")


@query(
    "e5_e6_smooth_runs",
    "SELECT call_id, run_idx, speaker FROM smooth",
    "noisy_words",
    **NOISY,
    smooth=smooth_sql("runs"),
)
def e5(t):
    return smoothing.smooth_short_runs(runs.speaker_runs(t["noisy_words"])).select("call_id", "run_idx", "speaker")


TWO = "(SELECT * FROM runs WHERE call_id IN (SELECT call_id FROM runs GROUP BY call_id HAVING count(DISTINCT CASE WHEN speaker <> 'IVR' THEN speaker END) <= 2))"


@query(
    "e5_smooth_standard",
    f"SELECT call_id, speaker, count(*) AS n_runs, CAST(sum(n_words) AS BIGINT) AS n_words FROM ({merge_sql('smooth')}) m GROUP BY call_id, speaker",
    "noisy_words",
    **NOISY,
    two=f"SELECT * FROM {TWO} x",
    smooth=smooth_sql("two"),
)
def e5_standard(t):
    base = runs.speaker_runs(t["noisy_words"])
    few = runs.call_totals(base).where("call_speakers <= 2").select("call_id")
    fixed = runs.merge(runs.regroup(smoothing.smooth_short_runs(base.join(few, "call_id", "left_semi"))))
    return fixed.groupBy("call_id", "speaker").agg(
        F.count(F.lit(1)).alias("n_runs"), F.sum("n_words").alias("n_words")
    )


@query(
    "e6_smooth_conservative",
    f"SELECT call_id, speaker, count(*) AS n_runs, CAST(sum(n_words) AS BIGINT) AS n_words FROM ({merge_sql('smooth')}) m GROUP BY call_id, speaker",
    "noisy_words",
    **NOISY,
    many=f"SELECT * FROM runs WHERE call_id NOT IN (SELECT call_id FROM {TWO} x)",
    smooth=smooth_sql("many"),
)
def e6(t):
    base = runs.speaker_runs(t["noisy_words"])
    more = runs.call_totals(base).where("call_speakers > 2").select("call_id")
    fixed = runs.merge(runs.regroup(smoothing.smooth_short_runs(base.join(more, "call_id", "left_semi"))))
    return fixed.groupBy("call_id", "speaker").agg(
        F.count(F.lit(1)).alias("n_runs"), F.sum("n_words").alias("n_words")
    )


@query(
    "e7_boundary_fix",
    "SELECT call_id, run_idx, speaker FROM fixed",
    "noisy_words",
    **NOISY,
    fixed=boundary_sql("runs"),
)
def e7(t):
    return smoothing.fix_boundaries(runs.speaker_runs(t["noisy_words"])).select("call_id", "run_idx", "speaker")


@query(
    "e8_mid_sentence_fix",
    "SELECT call_id, run_idx, speaker FROM fixed",
    "noisy_words",
    **NOISY,
    fixed=sentence_sql("runs"),
)
def e8(t):
    return smoothing.fix_mid_sentence(runs.speaker_runs(t["noisy_words"])).select("call_id", "run_idx", "speaker")


@query(
    "e9_approximate_words",
    """SELECT call_id, turn AS chunk_idx, CAST(pos AS BIGINT) AS pos, tok AS text,
              pos * slot AS start_ms, (pos + 1) * slot AS end_ms, true AS approximate_timing
       FROM (SELECT conv_id AS call_id, turn, pos, tok,
                    CASE WHEN turn % 3 = 0 THEN 300.0 ELSE (1000.0 * (turn + 1)) / count(*) OVER (PARTITION BY conv_id, turn) END AS slot
             FROM tokens) t""",
    "tokens",
)
def e9(t):
    spans = t["conversations"].select(
        F.col("conv_id").alias("call_id"),
        F.col("turn").alias("chunk_idx"),
        "text",
        (F.col("turn") * 1000).alias("start_ms"),
        F.when(F.col("turn") % 3 == 0, F.col("turn") * 1000).otherwise((F.col("turn") * 2 + 1) * 1000).alias("end_ms"),
    )
    return align.approximate_words(spans)


# Positions of line ends per run follow from a recursive walk over sentence ends.
LINE_SQL = {
    "numbered": """SELECT *, CAST(sum(turn) OVER (PARTITION BY call_id ORDER BY word_idx) AS BIGINT) AS run_idx
       FROM (SELECT *, CASE WHEN speaker = coalesce(lag(speaker) OVER (PARTITION BY call_id ORDER BY word_idx), speaker) THEN 0 ELSE 1 END AS turn
             FROM noisy_words) a""",
    "run_ends": """SELECT call_id, run_idx, min(speaker) AS speaker, min(word_idx) AS lo, max(word_idx) AS hi,
       list(text ORDER BY word_idx) AS texts,
       list(word_idx ORDER BY word_idx) FILTER (WHERE regexp_matches(text, '[.?!]$')) AS stops
       FROM numbered GROUP BY call_id, run_idx""",
    "walk": """SELECT call_id, run_idx, 0 AS line_idx, lo AS a, coalesce(list_min(list_filter(stops, lambda x: x >= lo + 8)), hi) AS z, hi, stops, texts, lo, speaker FROM run_ends
       UNION ALL
       SELECT call_id, run_idx, line_idx + 1, z + 1, coalesce(list_min(list_filter(stops, lambda x: x >= z + 9)), hi), hi, stops, texts, lo, speaker FROM walk WHERE z < hi""",
}


@query(
    "e10_sentence_lines",
    """SELECT call_id, run_idx, line_idx, '[' || speaker || '] ' || array_to_string(texts[a - lo + 1 : z - lo + 1], ' ') AS line FROM walk""",
    "noisy_words",
    **LINE_SQL,
)
def e10(t):
    pieces = lines.run_pieces(runs.word_runs(t["noisy_words"]))
    return lines.sentence_lines(pieces).select("call_id", "run_idx", "line_idx", "line")


# Runs far longer than a piece: all words of half the calls as one speaker, one run without any stop, one with few.
LONG_SQL = {k: v.replace("noisy_words", "long_words") for k, v in LINE_SQL.items()}


def long_pieces(t):
    return lines.run_pieces(runs.word_runs(t["long_words"]))


@query(
    "e10_long_runs",
    """SELECT call_id, run_idx, line_idx, '[' || speaker || '] ' || array_to_string(texts[list_position(idx, a) : list_position(idx, z)], ' ') AS line FROM walk""",
    "long_words",
    numbered=LONG_SQL["numbered"],
    run_ends="""SELECT call_id, run_idx, min(speaker) AS speaker, list(word_idx ORDER BY word_idx) AS idx, list(text ORDER BY word_idx) AS texts,
       list(nth ORDER BY nth) FILTER (WHERE regexp_matches(text, '[.?!]$')) AS stops, count(*) AS n
       FROM (SELECT *, row_number() OVER (PARTITION BY call_id, run_idx ORDER BY word_idx) AS nth FROM numbered) r GROUP BY call_id, run_idx""",
    walk="""SELECT call_id, run_idx, 0 AS line_idx, idx[1] AS a, coalesce(list_min(list_filter(stops, lambda x: x > 8)), n) AS here, idx[coalesce(list_min(list_filter(stops, lambda x: x > 8)), n)] AS z, n, stops, texts, idx, speaker FROM run_ends
       UNION ALL
       SELECT call_id, run_idx, line_idx + 1, idx[here + 1], coalesce(list_min(list_filter(stops, lambda x: x > here + 8)), n), idx[coalesce(list_min(list_filter(stops, lambda x: x > here + 8)), n)], n, stops, texts, idx, speaker FROM walk WHERE here < n""",
)
def e10_long(t):
    return lines.sentence_lines(long_pieces(t)).select("call_id", "run_idx", "line_idx", "line")


@query(
    "e11_long_runs",
    "SELECT call_id, string_agg(text, ' ' ORDER BY word_idx) AS words FROM long_words GROUP BY call_id",
    "long_words",
)
def e11_long(t):
    return lines.plain_lines(long_pieces(t)).select("call_id", F.regexp_replace("line", r"^\[[^\]]+\] ", "").alias("words"))


@query(
    "e11_turn_rebuild",
    """SELECT call_id, string_agg('[' || speaker || '] ' || array_to_string(texts, ' '), chr(10) ORDER BY run_idx) AS transcript
       FROM run_ends GROUP BY call_id""",
    "noisy_words",
    **LINE_SQL,
)
def e11(t):
    return lines.documents(lines.plain_lines(lines.run_pieces(runs.word_runs(t["noisy_words"]))))


@query(
    "e12_speaker_turns",
    """SELECT call_id, CAST(1 + sum(CASE WHEN speaker <> prev THEN 1 ELSE 0 END) AS BIGINT) AS turns
       FROM (SELECT call_id, speaker, lag(speaker) OVER (PARTITION BY call_id ORDER BY seg_idx) AS prev FROM segments) t GROUP BY call_id""",
    "segments",
)
def e12(t):
    return transcripts.speaker_turns(t["segments"])


@query(
    "f5_first_lines",
    """SELECT call_id, run_idx AS line_no, '[' || speaker || '] ' || array_to_string(texts, ' ') AS line FROM run_ends WHERE run_idx < 30""",
    "noisy_words",
    **LINE_SQL,
)
def f5(t):
    every = lines.plain_lines(lines.run_pieces(runs.word_runs(t["noisy_words"])))
    return lines.first_lines(every, 30).select("call_id", F.col("line_no").cast("long"), "line")


@query(
    "b32_speaker_filter",
    "SELECT call_id, seg_idx, start_ms, end_ms FROM segments WHERE speaker = 'speaker_1'",
    "segments",
)
def b32(t):
    return transcripts.speaker_segments(t["segments"], "speaker_1").select("call_id", "seg_idx", "start_ms", "end_ms")


@query(
    "flagship_talk_time",
    """SELECT call_id, speaker, CAST(sum(end_ms - start_ms) AS BIGINT) AS talk_ms, count(*) AS turns,
              CAST(sum(n_words) AS BIGINT) AS n_words FROM runs GROUP BY call_id, speaker""",
    "aligned",
    runs=run_sql("aligned"),
)
def flagship(t):
    return transcripts.talk_and_turns(t["chunk_words"], t["segments"], t["chunks"])


K1_SQL = {
    "runs0": run_sql("aligned"),
    "runs1": f"SELECT * EXCLUDE (original_speaker) FROM ({renumber_sql('runs0')}) x",
    "sized": totals_sql("runs1"),
    "one_voice_words": """SELECT a.* FROM aligned a JOIN sized s ON a.call_id = s.call_id WHERE s.call_speakers <= 1""",
    **SILENCE_SQL,
    "split_words": """SELECT s.call_id, s.word_idx, s.text, s.start_ms, s.end_ms, s.st, t.turn, n, last_st
       FROM stretches s JOIN turns t ON s.call_id = t.call_id AND s.st = t.st""",
    "fixed_words": """SELECT call_id, word_idx, text, start_ms, end_ms,
       CASE WHEN n >= 5 AND last_st > 0 THEN 'speaker_' || CAST(turn % 2 AS VARCHAR) ELSE 'speaker_0' END AS speaker FROM split_words""",
    "runs2": f"""SELECT * FROM ({run_sql('fixed_words')}) a UNION ALL BY NAME
       SELECT * FROM runs1 WHERE call_id IN (SELECT call_id FROM sized WHERE call_speakers > 1)""",
    "runs3": f"SELECT * EXCLUDE (original_speaker) FROM ({renumber_sql('runs2')}) x",
    "runs4": merge_sql(f"({smooth_sql('runs3')}) x"),
    "speakers3": totals_sql("runs3"),
    "bounded": boundary_sql("runs4"),
    "runs5": f"""SELECT * FROM bounded WHERE call_id IN (SELECT call_id FROM speakers3 WHERE call_speakers <= 2) UNION ALL BY NAME
       SELECT * FROM runs4 WHERE call_id IN (SELECT call_id FROM speakers3 WHERE call_speakers > 2)""",
    "runs6": merge_sql("runs5"),
    "runs7": merge_sql(f"({sentence_sql('runs6')}) x"),
    "runs8": renumber_sql("runs7"),
}


@query(
    "k1_transcript_runs",
    "SELECT call_id, run_idx, speaker, first_idx, last_idx, n_words, start_ms, end_ms FROM runs8",
    "aligned",
    **K1_SQL,
)
def k1_runs(t):
    built = transcripts.assemble_transcripts(t["chunk_words"], t["segments"], t["chunks"])
    return built.turns.select("call_id", "run_idx", "speaker", "first_idx", "last_idx", "n_words", "start_ms", "end_ms")


@query(
    "k1_assemble_transcripts",
    """SELECT call_id, string_agg('[' || speaker || '] ' || line, chr(10) ORDER BY run_idx, line_idx) AS transcript
       FROM (SELECT call_id, run_idx, line_idx, speaker, array_to_string(texts[a - lo + 1 : z - lo + 1], ' ') AS line FROM walk) x
       GROUP BY call_id""",
    "aligned",
    **K1_SQL,
    run_ends="""SELECT r.call_id, r.run_idx, r.speaker, r.first_idx AS lo, r.last_idx AS hi, list(a.text ORDER BY a.word_idx) AS texts,
       list(a.word_idx ORDER BY a.word_idx) FILTER (WHERE regexp_matches(a.text, '[.?!]$')) AS stops
       FROM runs8 r JOIN aligned a ON a.call_id = r.call_id AND a.word_idx BETWEEN r.first_idx AND r.last_idx
       GROUP BY r.call_id, r.run_idx, r.speaker, r.first_idx, r.last_idx""",
    walk=LINE_SQL["walk"],
)
def k1(t):
    return transcripts.assemble_transcripts(t["chunk_words"], t["segments"], t["chunks"]).documents()


@query(
    "d19_conversation_metrics",
    """SELECT call_id, count(DISTINCT speaker) AS total_speakers,
              round(100.0 * sum(CASE WHEN speaker = 'speaker_1' THEN end_ms - start_ms ELSE 0 END) / sum(end_ms - start_ms), 4) AS agent_talk_percent,
              round(100.0 * sum(CASE WHEN speaker = 'speaker_0' THEN end_ms - start_ms ELSE 0 END) / sum(end_ms - start_ms), 4) AS customer_talk_percent,
              CAST(sum(CASE WHEN prev IS NOT NULL AND prev <> speaker AND start_ms < prev_end THEN 1 ELSE 0 END) AS BIGINT) AS interruptions
       FROM (SELECT *, lag(speaker) OVER (PARTITION BY call_id ORDER BY seg_idx) AS prev,
                    lag(end_ms) OVER (PARTITION BY call_id ORDER BY seg_idx) AS prev_end FROM segments) t GROUP BY call_id""",
    "segments",
)
def d19(t):
    return transcripts.conversation_metrics(t["segments"], agent="speaker_1", customer="speaker_0")


@query(
    "d19_questions_and_pace",
    """SELECT call_id, count(*) FILTER (WHERE text LIKE '%?%') AS question_count, count(*) AS n_words,
              round(60000.0 * count(*) / (max(end_ms) - min(start_ms)), 4) AS words_per_minute,
              CASE WHEN 60000.0 * count(*) / (max(end_ms) - min(start_ms)) < 110 THEN 'slow'
                   WHEN 60000.0 * count(*) / (max(end_ms) - min(start_ms)) > 170 THEN 'fast' ELSE 'normal' END AS pace_rating
       FROM words GROUP BY call_id""",
    "words",
)
def d19_pace(t):
    return transcripts.questions_and_pace(t["words"])
