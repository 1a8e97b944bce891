"""Alignment and fusion queries over all tracks, against plain Python."""

from collections import defaultdict

import pytest

from trackspark.demo_tracks import points
from trackspark.queries import QUERIES

from .conftest import DATA


@pytest.fixture(scope="module")
def rows(spark):
    return points(spark, DATA).orderBy("track_id", "seq").collect()


@pytest.fixture(scope="module")
def tracks(rows):
    """Valid timed points of each track."""
    out = defaultdict(list)
    for r in rows:
        if r["time_ms"] is not None and -90 <= r["lat"] <= 90:
            out[r["track_id"]].append(r)
    return out


def pairs(tracks):
    names = sorted(tracks)
    return [(a, b, f"{a}-{b}") for a, b in zip(names, names[1:] + names[:1])]


def test_nearest_of_every_track(spark, tracks):
    want = set()
    for a, b, pair in pairs(tracks):
        for r in tracks[a]:
            x = min(tracks[b], key=lambda t: (abs(t["time_ms"] - r["time_ms"]), t["time_ms"], -t["seq"] if t["time_ms"] < r["time_ms"] else t["seq"]))
            if abs(x["time_ms"] - r["time_ms"]) <= 3000:
                want.add((pair, r["seq"], x["seq"]))
    got = [(r["pair"], r["ref_seq"], r["tgt_seq"]) for r in QUERIES["align_nearest_all"](spark, DATA).collect()]
    assert len(got) == len(want) and set(got) == want and len({x[0] for x in got}) == 12


def test_bracket_of_every_track(spark, tracks):
    want = set()
    for a, b, pair in pairs(tracks):
        for r in tracks[a]:
            before = [t for t in tracks[b] if t["time_ms"] < r["time_ms"]] or [t for t in tracks[b] if t["time_ms"] == r["time_ms"]][:1]
            behind = [t for t in tracks[b] if t["time_ms"] >= r["time_ms"]]
            if before and behind:
                x, y = max(before, key=lambda t: (t["time_ms"], t["seq"])), min(behind, key=lambda t: (t["time_ms"], t["seq"]))
                if y["time_ms"] - x["time_ms"] <= 15000:
                    want.add((pair, r["seq"], x["seq"], y["seq"]))
    got = [(r["pair"], r["ref_seq"], r["tgt_seq"], r["tgt_after_seq"]) for r in QUERIES["align_interpolated_all"](spark, DATA).collect()]
    assert len(got) == len(want) and set(got) == want


def test_pair_of_all_equals_the_pair_alone(spark):
    for name in ("relative_position", "clock_drift", "closest_approach", "comparison_range_stats"):
        every, alone = QUERIES[f"{name}_all"](spark, DATA).collect(), QUERIES[name](spark, DATA).collect()
        assert len({r["pair"] for r in every}) == 12
        assert sorted(map(str, every)) == sorted(map(str, alone))


def test_position_at_every_time(spark, rows, tracks):
    want = []
    for q in rows:
        if q["time_ms"] is None:
            continue
        at, own = q["time_ms"] + 100, tracks[q["track_id"]]
        before, behind = [t for t in own if t["time_ms"] < at], [t for t in own if t["time_ms"] >= at]
        if not behind:
            continue
        y = min(behind, key=lambda t: (t["time_ms"], t["seq"]))
        x = max(before, key=lambda t: (t["time_ms"], t["seq"])) if before else None
        if y["time_ms"] == at:
            want.append((q["track_id"], at, y["lat"]))
        elif x and y["time_ms"] - x["time_ms"] <= 20000:
            want.append((q["track_id"], at, x["lat"] + (y["lat"] - x["lat"]) * (at - x["time_ms"]) / (y["time_ms"] - x["time_ms"])))
    got = [(r["track_id"], r["at_ms"], r["lat"]) for r in QUERIES["position_at_time_all"](spark, DATA).collect()]
    assert len(got) == len(want)
    for g, w in zip(sorted(got), sorted(want)):
        assert g[0] == w[0] and abs(g[1] - w[1]) < 0.01 and abs(g[2] - w[2]) < 2e-6


def test_every_candidate_is_fused(spark, tracks):
    n = sum(map(len, tracks.values()))
    assert QUERIES["fusion_candidates_all"](spark, DATA).count() == n
    groups = defaultdict(list)
    for name, own in tracks.items():
        groups[f"E{int(name[1:]) // 3}"] += [t["time_ms"] for t in own]
    want = []
    for entity, times in groups.items():
        anchor = None
        for t in sorted(times):
            if anchor is None or t - anchor > 1500:
                want.append([entity, t, 0])
                anchor = t
            want[-1][2] += 1
    got = [[r["entity"], r["anchor"], r["n"]] for r in QUERIES["fusion_groups"](spark, DATA).collect()]
    assert [(e, n) for e, _, n in sorted(got)] == [(e, n) for e, _, n in sorted(want)]
    report = QUERIES["fusion_report"](spark, DATA).collect()
    assert len(report) == 12 and sum(r["chosen"] + r["skipped"] for r in report) == n
    assert QUERIES["fusion_decisions"](spark, DATA).count() == len(want) == sum(r["chosen"] for r in report)
