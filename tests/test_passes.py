"""Composed alignment: windows, lookahead, rescue, merge and choice, on worked values and against a plain version."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cantabile.operators import align, passes
from cantabile.schema import profile
from cantabile.sources.views import letter_ids, sung_frames, sung_texts

DATA = "/root/testdata/sf0.001"
WORDS = "array<struct<word string, normalized string, ids array<int>>>"
LINES = f"track_id long, line_idx long, anchor_ms long, words {WORDS}"


def word(text, ids=None):
    return (text, text, list(ids) if ids is not None else [ord(c) - 96 for c in text])


def blocks(spark, path, size=4, vocabulary=6, hit=0.95):
    """A track whose frames say `path` clearly, in blocks of four frames."""
    rows = [[math.log(hit if v == t else (1 - hit) / (vocabulary - 1)) for v in range(vocabulary)] for t in path]
    cut = [(1, b, rows[b * size : (b + 1) * size]) for b in range(-(-len(rows) // size))]
    return passes.Sound(spark.createDataFrame(cut, "track_id long, block long, logp array<array<double>>"), 100, size)


def asked(spark, lines, duration, pre, post, last, lookahead):
    df = passes.with_next(spark.createDataFrame(lines, LINES), F.lit(duration))
    return passes.request(df, "first", pre, post, last, lookahead)


def test_window_reaches_from_before_the_anchor_past_the_next(spark):
    r = asked(spark, [(1, 0, 42100, [word("a")]), (1, 1, 46300, [word("a")])], 240_000, 0.95, 0.35, 11, 0)
    w = passes.fitted(r, blocks(spark, [0])).where("line_idx = 0").first()
    assert (w.window_start_ms, w.window_end_ms) == (41150, 46650)
    r = asked(spark, [(1, 0, 120_000, [word("a")])], 180_000, 1.0, 0.3, 9, 0)
    w = passes.fitted(r, blocks(spark, [0])).first()
    assert (w.window_start_ms, w.window_end_ms) == (119_000, 129_000)
    assert not w._heard and w._fit is None  # no frames there


def test_lookahead_gives_words_of_this_line_only(spark):
    path = [0, 1, 2, 0, 0, 3, 4, 0, 0, 0]
    r = asked(spark, [(1, 0, 0, [word("ab")]), (1, 1, 500, [word("cd")])], 1000, 0.1, 0.5, 9, 1)
    got = passes.align_lines(r, blocks(spark, path)).where("line_idx = 0").first()
    assert [w.word for w in got.words] == ["ab"] and got.used == 1
    assert (got.words[0].start_ms, got.words[0].end_ms, got.lookahead_ms) == (100, 300, 500)
    assert got.words[0].start_ms < got.lookahead_ms and got.lead_ms == 400 and got.gap_ms == 400


def test_lookahead_backs_off_to_what_the_frames_hold():
    logp = np.log(np.full((4, 3), 1 / 3))
    assert passes.fit(logp, [[2]], [[1], [1], [1]])["used"] == 2
    assert passes.fit(logp, [[2, 2, 2]], []) is None
    assert passes.fit(logp, [[7]], []) is None


def test_words_without_letters_and_lines_without_a_path(spark):
    lines = [(1, 0, 0, [word("♪", []), word("♪", [])]), (1, 1, 600, [word("aaaaaaaa")]), (1, 2, None, [word("a")]), (1, 3, 700, [])]
    r = asked(spark, lines, 1000, 0.1, 0.1, 9, 1)
    got = {x.line_idx: x for x in passes.align_lines(r, blocks(spark, [0] * 10)).collect()}
    assert {i: r.method for i, r in got.items()} == {0: "even_no_letters", 1: "even_no_path"}
    assert [(w.start_ms, w.end_ms) for w in got[1].words] == [(600, 700)] and got[1].silent and got[1].conf == 0.1
    assert [(w.start_ms, w.end_ms, w.conf, w.origin) for w in got[0].words] == [(0, 300, 0.1, "interpolated_unsupported_token"), (300, 600, 0.1, "interpolated_unsupported_token")]
    assert got[0].lead_ms is None and got[0].conf == 0.1


def slow_viterbi(logp, target, blank=0):
    """Frame by frame and state by state."""
    states = [blank]
    for t in target:
        states += [t, blank]
    score, came = [-math.inf] * len(states), []
    for s in range(min(2, len(states))):
        score[s] = logp[0][states[s]]
    for t in range(1, len(logp)):
        now, steps = [], []
        for s, x in enumerate(states):
            options = [(score[s], 0)]
            if s >= 1:
                options.append((score[s - 1], 1))
            if s >= 2 and x != blank and x != states[s - 2]:
                options.append((score[s - 2], 2))
            best = max(options, key=lambda o: (o[0], -o[1]))
            now.append(best[0] + logp[t][x])
            steps.append(best[1])
        score = now
        came.append(steps)
    at = len(states) - 2 if score[-2] > score[-1] else len(states) - 1
    if score[at] == -math.inf:
        return None
    path = [at]
    for steps in reversed(came):
        at -= steps[at]
        path.append(at)
    path.reverse()
    out = []
    for i, t in enumerate(target):
        on = [f for f, s in enumerate(path) if s == 2 * i + 1]
        out.append((i, t, on[0], on[-1] + 1, sum(math.exp(logp[f][t]) for f in on) / len(on)))
    return out


def test_paths_side_by_side_equal_one_state_at_a_time():
    rng = np.random.default_rng(11)
    logps, targets = [], []
    for _ in range(120):
        frames, vocabulary = int(rng.integers(1, 30)), int(rng.integers(2, 6))
        p = rng.dirichlet(np.full(vocabulary, 0.5), frames)
        if rng.random() < 0.3:
            p = np.round(p, 1) + 1e-12 * (rng.random() < 0.5)  # ties, and paths of no probability
        with np.errstate(divide="ignore"):
            logps.append(np.log(p))
        targets.append(rng.integers(1, vocabulary, int(rng.integers(1, 9))).tolist())
    got = align.viterbi_all(logps, targets)
    none = 0
    for logp, target, spans in zip(logps, targets, got):
        want = slow_viterbi(logp.tolist(), target)
        assert (spans is None) == (want is None)
        none += want is None
        assert want is None or all(a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-9) for a, b in zip(spans, want, strict=True))
    assert 20 < none < 110 and align.viterbi_all([logps[0]], [[]]) == [[]]


def plain_line(line, following, sound, p, block=10, frame=40):
    """One line aligned by hand, all its fields; sound: {block: frames} of its track."""
    lo = max(0, line["anchor_ms"] - round(1000 * p["pre"]))
    post = round(1000 * p["post"])
    after = following and following["anchor_ms"]
    hi = min(line["duration_ms"], after + post if after is not None and after > line["anchor_ms"] + 50 else line["anchor_ms"] + round(1000 * p["last_window"]))
    hi = max(hi, lo + 200)
    first, last = lo // frame, (min(hi, line["duration_ms"]) - 1) // frame
    asked = [b for b in range(first // block, max(first, last) // block + 1)]
    have = [b for b in asked if b in sound]
    whole = bool(have) and have[0] == asked[0] and have[-1] - have[0] + 1 == len(have)
    frames = [f for b in have for f in sound[b]][first % block :][: last - first + 1] if whole else None
    ids = [list(w.ids) for w in line["words"]]
    ahead = [list(w.ids) for w in following["words"]][: p["lookahead"]] if following else []
    method, spans, used = "ctc", None, 0
    if not any(ids):
        method = "even_no_letters"
    elif frames is None:
        method = "even_frames_lost"
    else:
        for used in range(len(ahead), -1, -1):
            spans = align.viterbi(np.array(frames), [x for w in ids + ahead[:used] for x in w])
            if spans:
                break
        method = "ctc" if spans else "even_no_path"
    at, words, seen = 0, [], None
    for n, w in enumerate(ids + (ahead[:used] if spans else [])):
        own = spans[at : at + len(w)] if spans else []
        at += len(own)
        conf = round(float(np.mean([s[4] for s in own])), 4) if own else None
        start = (first + own[0][2]) * frame if own else None
        end = max(start + 10, (first + own[-1][3]) * frame) if own else None
        if n < len(ids):
            words.append([start, end, conf, "aligned_low_confidence" if conf is not None and conf < 0.25 else "aligned"])
        elif own and seen is None:
            seen = (start, conf)
    timed = [w for w in words if w[0] is not None]
    edge = after if after is not None and after > line["anchor_ms"] else min(line["duration_ms"], line["anchor_ms"] + 1500)
    begin, stop = (timed[0][0], max(w[1] for w in timed)) if timed else (line["anchor_ms"], max(line["anchor_ms"] + 50, edge))
    conf = round(sum(w[2] for w in timed) / len(timed), 4) if timed else 0.10
    i = 0
    while i < len(words):
        if words[i][0] is not None:
            i += 1
            continue
        j = i
        while j < len(words) and words[j][0] is None:
            j += 1
        left, right = words[i - 1][1] if i else begin, words[j][0] if j < len(words) else stop
        span = max(30 * (j - i), right - left)
        for k in range(i, j):
            words[k] = [left + span * (k - i) // (j - i), left + span * (k - i + 1) // (j - i), 0.10, "interpolated_unsupported_token"]
        i = j
    cap = None if method != "ctc" else seen[0] if seen else after + post if after is not None and after > line["anchor_ms"] else None
    end = max(w[1] for w in words)
    if cap is not None:
        for w in words:
            if w[1] > cap:
                w[1:] = [max(w[0] + 10, cap), min(w[2], 0.35), "repaired_boundary_context_cap"]
        end = min(max(w[1] for w in words), max(words[0][0] + 50, cap))
    start = words[0][0]
    lead = after - words[-1][0] if method == "ctc" and after is not None else None
    gap = seen[0] - words[-1][0] if method == "ctc" and seen else None
    return {"method": method, "used": used if spans else 0, "words": [tuple(w) for w in words], "conf": conf, "start_ms": start, "end_ms": max(start + 50, end), "lookahead_ms": seen and seen[0], "lookahead_conf": seen and seen[1], "anchor_delta_ms": start - line["anchor_ms"], "lead_ms": lead, "gap_ms": gap, "window_start_ms": lo, "window_end_ms": hi}


@pytest.mark.parametrize("name, stretch", [("balanced", 48_000), ("max", 48_000), ("fast", 4_000)])
def test_one_pass_equals_a_plain_version(spark, name, stretch, monkeypatch):
    """Every field of every line; a tenth of the blocks of some tracks are lost, and with short stretches most windows gather their frames by themselves."""
    monkeypatch.setattr(passes, "STRETCH_MS", stretch)
    p = profile(name)
    texts, frames = sung_texts(spark, DATA), sung_frames(spark, DATA).where("track_id % 3 <> 0 or block % 10 <> 7")
    known = passes.with_next(texts, F.col("duration_ms"))
    got = {(r.track_id, r.line_idx): r for r in passes.align_lines(passes.request(known, "first", p["pre"], p["post"], p["last_window"], p["lookahead"]), passes.Sound(frames, 40, 10)).collect()}
    tracks, sound = {}, {}
    for r in texts.orderBy("track_id", "line_idx").collect():
        tracks.setdefault(r.track_id, []).append(r)
    for r in frames.collect():
        sound.setdefault(r.track_id, {})[r.block] = r.logp
    methods = {}
    for t, lines in tracks.items():
        for i, line in enumerate(lines):
            want = plain_line(line, lines[i + 1] if i + 1 < len(lines) else None, sound[t], p)
            have = got.pop((t, line.line_idx))
            methods[want["method"]] = methods.get(want["method"], 0) + 1
            assert [(w.start_ms, w.end_ms, w.origin) for w in have.words] == [(w[0], w[1], w[3]) for w in want["words"]]
            assert [w.conf for w in have.words] == pytest.approx([w[2] for w in want["words"]], abs=1.01e-4)
            for k in ("method", "used", "start_ms", "end_ms", "lookahead_ms", "anchor_delta_ms", "lead_ms", "gap_ms", "window_start_ms", "window_end_ms"):
                assert have[k] == want[k], (t, line.line_idx, k)
            assert have.conf == pytest.approx(want["conf"], abs=1.01e-4) and (have.lookahead_conf is None) == (want["lookahead_conf"] is None)
            confs = sorted(w.conf for w in have.words)
            n = len(confs)
            lead = 0 if have.lead_ms is None else 0.28 if have.lead_ms < -80 else 0.12 if have.lead_ms < 30 else 0
            gap = 0 if have.gap_ms is None else 0.30 if have.gap_ms <= 0 else 0.10 if have.gap_ms < 55 else 0
            score = 0.50 * have.conf + 0.18 * have.words[-1].conf + 0.20 * (confs[(n - 1) // 2] + confs[n // 2]) / 2 + 0.12 * confs[0] - 0.16 * sum(c < 0.45 for c in confs) / n
            assert have.score == pytest.approx(score - min(0.22, abs(have.anchor_delta_ms) / 1000 * 0.055) - lead - gap, abs=1e-9)
    assert not got and methods["ctc"] > 60 and methods["even_frames_lost"] > 5


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def test_last_word_next_to_the_next_line_is_doubtful(spark):
    assert one(spark, s=align.suspicious(F.lit(0.9), F.lit(9940), F.lit(9990), F.lit(10000), F.lit(None).cast("long"), F.lit(11200), 0.54, 300)).s


def last(conf, start, end):
    return F.struct(F.lit(conf).alias("conf"), F.lit("aligned").alias("origin"), F.lit(start).alias("start_ms"), F.lit(end).alias("end_ms"))


def test_boundary_rescue_takes_the_earlier_word(spark):
    primary, second = last(0.82, 9980, 10040), last(0.80, 9540, 9920)
    take = lambda a, b, doubt=True: passes.boundary_accepted(a, b, F.lit(10000), F.lit(10100), F.lit(10080), F.lit(doubt))
    got = one(spark, a=take(primary, second), b=take(second, primary), c=take(second, second))
    assert (got.a, got.b, got.c) == (True, False, False)
    score = lambda w: align.last_word_score(w["conf"], w["origin"], w["start_ms"], w["end_ms"], F.lit(10000), F.lit(10080))
    got = one(spark, stuck=score(last(0.82, 9990, 10050)), rescued=score(last(0.80, 9550, 9910)))
    assert got.stuck == pytest.approx(0.64) and got.rescued == pytest.approx(0.8159)


RESULT = (
    "track_id long, line_idx long, pass_idx int, variant string, anchor_ms long, next_anchor_ms long, duration_ms long, window_start_ms long, window_end_ms long, lookahead_ms long, lookahead_conf double, used int, silent boolean, method string, "
    "words array<struct<word_idx int, word string, normalized string, start_ms long, end_ms long, conf double, origin string>>, conf double, start_ms long, end_ms long, anchor_delta_ms long, adaptive boolean, lead_ms long, gap_ms long, score double"
)


def candidate(i, start, conf):
    words = [(0, "hello", "hello", 1000, 1250, 0.92, "aligned"), (1, "world", "world", start, min(2000, start + 200), conf, "aligned_low_confidence")]
    return (1, 0, i, "first", 1000, None, 9000, 0, 3000, 2000, 0.9, 1, False, "ctc", words, 0.7, 1000, 2000, 0, False, None, None, 0.0)


def test_merge_uses_tempo_only_for_the_unstable_word(spark):
    rows = [candidate(0, 1920, 0.22), candidate(1, 1480, 0.27), candidate(2, 1720, 0.24)]
    candidates = passes.scored(spark.createDataFrame(rows, RESULT))
    priors = spark.createDataFrame([(1, 0, 0.075)], "track_id long, line_idx long, prior double")
    (got,) = passes.merged(candidates, priors).collect()
    first, second = got.words
    assert (first.origin, second.origin) == ("adaptive_consensus", "tempo_energy_rescue")
    assert (second.start_ms, second.end_ms) == (1261, 2000) and second.conf == pytest.approx(0.3544)
    assert got.conf == pytest.approx(0.6497, abs=1e-4) and got.adaptive


def test_a_phrase_out_of_tempo_is_told(spark):
    words = [(0, "one", "one", 1000, 1150, 0.8, "aligned"), (1, "broken", "broken", 1150, 2800, 0.55, "aligned"), (2, "three", "three", 2800, 3000, 0.82, "aligned")]
    row = (1, 0, 0, "first", 1000, 3000, 9000, 0, 5000, 3000, 0.9, 1, False, "ctc", words, 0.76, 1000, 3000, 0, False, 200, 200, 0.0)
    now = spark.createDataFrame([row], RESULT)
    priors = spark.createDataFrame([(1, 0, 0.055)], "track_id long, line_idx long, prior double")
    (got,) = passes.reasons(passes.profiled(now, profile("max")), priors).collect()
    assert "tempo_outlier" in got.reasons and "very_low_word_confidence" not in got.reasons


@pytest.mark.parametrize("name", ["fast", "max"])
def test_all_passes_keep_every_line_once(spark, name):
    texts = sung_texts(spark, DATA).where("track_id < 6")
    known = passes.with_next(texts, F.col("duration_ms"))
    sound = passes.Sound(sung_frames(spark, DATA), 40, 10)
    p = profile(name)
    first = passes.align_lines(passes.request(known, "first", p["pre"], p["post"], p["last_window"], p["lookahead"]), sound)
    want = {(r.track_id, r.line_idx): r.score for r in first.collect()}
    got = passes.align_tracks(known, sound, p).collect()
    assert sorted((r.track_id, r.line_idx) for r in got) == sorted(want) and len(want) > 5
    for r in got:
        if not r.adaptive and not r.variant.endswith("+boundary"):
            assert r.score >= want[r.track_id, r.line_idx]
        assert all(a.start_ms < b.start_ms for a, b in zip(r.words, r.words[1:])) or not r.adaptive
    empty = passes.align_tracks(known.where("false"), sound, p)
    assert empty.count() == 0


def test_letter_ids(spark):
    assert spark.createDataFrame([("aes",), ("",)], "w string").select(letter_ids(F.col("w")).alias("i")).collect() == [([1, 2, 10],), ([],)]
