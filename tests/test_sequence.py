"""Two-level scans against straight-line Python, with tiny blocks."""

import random

from pyspark.sql import functions as F

from callflow.operators import lines, runs, segments, smoothing
from callflow.operators.sequence import index_block, label_runs, neighbours, number_rows, running_sum


def sample(seed=1, calls=4, n=60, speakers=3):
    rnd = random.Random(seed)
    rows = []
    for c in range(calls):
        t, who = 0, 0
        for i in range(rnd.randint(1, n)):
            if rnd.random() < 0.3:
                who = rnd.randrange(speakers)
            t += rnd.choice([0, 10, 10, 40, 900, 1500]) if i else 0
            text = rnd.choice(["yes", "no.", "why?", "well", "ok!"])
            rows.append((c, i, text, t, t + 90, f"speaker_{who}"))
            t += 90
    return rows


COLS = "call_id long, word_idx long, text string, start_ms long, end_ms long, speaker string"


def per_call(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def test_scans_cross_blocks(spark):
    rows = sample(2)
    df = spark.createDataFrame(rows, COLS)
    block = index_block("word_idx", 3)
    near = {(r.call_id, r.word_idx): r for r in neighbours(df, ["call_id"], ["word_idx"], block, ["text"], ["speaker"]).collect()}
    run = {(r.call_id, r.word_idx): r.run_idx for r in label_runs(df, ["call_id"], ["word_idx"], block, "speaker").collect()}
    total = {(r.call_id, r.word_idx): r.s for r in running_sum(df, ["call_id"], ["word_idx"], block, F.col("end_ms"), "s").collect()}
    place = {(r.call_id, r.word_idx): r.p for r in number_rows(df, ["call_id"], ["word_idx"], block, "p").collect()}
    for call, words in per_call(rows).items():
        k, s = 0, 0
        for i, w in enumerate(words):
            k += i > 0 and w[5] != words[i - 1][5]
            s += w[4]
            got = near[call, i]
            assert (run[call, i], total[call, i], place[call, i]) == (k, s, i)
            assert got.has_prev == (i > 0) and got.has_next == (i + 1 < len(words))
            assert got.prev_text == (words[i - 1][2] if i else None)
            assert got.next_speaker == (words[i + 1][5] if i + 1 < len(words) else None)


def fold_lines(words):
    out, who, line = [], None, []
    for i, w in enumerate(words):
        if w[5] != who:
            if line:
                out.append((who, line))
            who, line = w[5], [w[2]]
            continue
        line.append(w[2])
        if w[2][-1] in ".?!" and len(line) > 8:
            out.append((who, line))
            line = []
    return out + ([(who, line)] if line else [])


def test_sentence_lines_in_pieces(spark, monkeypatch):
    rows = sample(3, calls=3, n=120, speakers=2)
    df = spark.createDataFrame(rows, COLS)
    want = {c: [f"[{s}] {' '.join(x)}" for s, x in fold_lines(ws)] for c, ws in per_call(rows).items()}
    def sentences():
        got = {}
        for r in lines.sentence_lines(lines.run_pieces(runs.word_runs(df))).orderBy("call_id", "run_idx", "line_idx").collect():
            got.setdefault(r.call_id, []).append(r.line)
        return got

    def plain():
        return sorted(map(tuple, lines.plain_lines(lines.run_pieces(runs.word_runs(df))).collect()))

    whole = plain()
    assert sentences() == want
    # pieces of a few words give the same lines
    monkeypatch.setattr(lines, "PIECE_WORDS", 4)
    assert sentences() == want
    assert plain() == whole


def split_model(words):
    if len(words) < 5:
        return [w[5] for w in words]
    gaps = [words[i][3] - words[i - 1][4] for i in range(1, len(words))]
    pos = sorted(g for g in gaps if g > 0)
    if not pos:
        return [w[5] for w in words]
    limit = max(800, 3 * pos[len(pos) // 2])
    if sum(g >= limit for g in gaps) < 3:
        limit = max(300, pos[int(len(pos) * 0.75)])
    cuts = [i + 1 for i, g in enumerate(gaps) if g >= limit]
    if not cuts:
        return [w[5] for w in words]
    spans = list(zip([0, *cuts], [*cuts, len(words)]))
    names, who = [], 0
    for k, (a, b) in enumerate(spans):
        if k and b - a >= 3:
            who = 1 - who
        names += [f"speaker_{who}"] * (b - a)
    return names


def test_silence_split(spark):
    rows = [(*r[:5], "speaker_0") for r in sample(5, calls=8, n=50)]
    got = {}
    for r in smoothing.split_by_silence(spark.createDataFrame(rows, COLS)).orderBy("call_id", "word_idx").collect():
        got.setdefault(r.call_id, []).append(r.speaker)
    assert got == {c: split_model(ws) for c, ws in per_call(rows).items()}


def plan_model(silence, total, target, drift, pad):
    out, start = [], 0
    while start < total:
        goal = start + target
        if goal >= total:
            out.append((start, total))
            break
        near = [t for t in silence if max(0, goal - drift) <= t <= min(total, goal + drift)]
        cut = min(near, key=lambda t: abs(t - goal)) if near else goal
        out.append((start, min(cut + pad, total)))
        start = cut
    return out


def test_chunk_plan(spark):
    rnd = random.Random(7)
    frames, want, totals = [], {}, []
    for call in range(4):
        probs, p = [], 1.0
        for _ in range(rnd.randint(30, 200)):
            p = rnd.choice([0.0, 1.0]) if rnd.random() < 0.15 else p
            probs.append(p)
        frames += [(call, i, x) for i, x in enumerate(probs)]
        totals.append((call, 30 * len(probs)))
        want[call] = plan_model([30 * i for i, x in enumerate(probs) if x == 0], 30 * len(probs), 900, 200, 50)
    spans = segments.silence_spans(spark.createDataFrame(frames, "call_id long, frame_idx long, speech_prob double"))
    got = {}
    plan = segments.plan_chunks(spans, spark.createDataFrame(totals, "call_id long, total_ms long"), 900, 200, 50)
    for r in plan.orderBy("call_id", "chunk_idx").collect():
        got.setdefault(r.call_id, []).append((r.start_ms, r.end_ms))
    assert got == want
