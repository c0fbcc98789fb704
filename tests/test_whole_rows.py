"""Registered queries see all rows: plain Python over whole views of the smallest tables."""

import math
import re

import pytest

from kestrel.operators import resolve as E
from kestrel.plans import correlation, networks, records, rings
from kestrel.sources.bindings import view

SF = "/root/testdata/sf0.01"


def rows(spark, name):
    return view(spark, SF, name).collect()


def groups(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def tier_of(one, two, phones):
    (a, g), (b, h) = one, two
    j = len(a & b) / len(a | b) if a and b else 0.0
    if phones[0] and phones[0] == phones[1]:
        return j, "high"
    return j, "high" if j >= 0.7 else "probable" if j >= 0.5 else "possible" if j >= 0.3 and len(g & h) >= 3 else None


def worded(text):
    words = re.findall("[a-z]{3,}", (text or "").lower())
    return frozenset(words), frozenset(zip(words, words[1:]))


def linked(texts, phones):
    first = {}
    for i in sorted(texts):
        first.setdefault((worded(texts[i]), phones.get(i)), i)
    ids, out = sorted(first.values()), {}
    held = {i: worded(texts[i]) for i in ids}
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            j, tier = tier_of(held[a], held[b], (phones.get(a), phones.get(b)))
            if tier:
                out[a, b] = (round(j, 6), tier)
    return out


def test_script_links_bigrams_and_phones(spark):
    texts = {1: "one two three four five six seven", 2: "seven one three five two four six", 3: "one two three four nine ten else", 4: "one three two nine four ten nil", 5: "far away from all", 6: "", 7: "other words here", 8: "four three two one ate bat cat"}
    phones = {5: "98", 6: "98", 7: "98", 1: "", 8: ""}
    df = spark.createDataFrame([(i, t, phones.get(i)) for i, t in texts.items()], "event_id long, text string, phone string")
    got = {(r.a, r.b): (round(r.jaccard, 6), r.tier) for r in E.script_links(df).collect()}
    assert got == linked(texts, phones) and got[1, 2][1] == "high" and got[5, 6] == got[5, 7] == (0.0, "high") and got[1, 3][1] == "possible" and (1, 8) not in got


def test_long_scripts_are_linked(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in view(spark, sf, "messages").collect()}
    assert any(len(t) >= 1500 for t in texts.values())
    got = {(r.a, r.b): (r.jaccard, r.tier) for r in correlation.e04_script_links(spark, sf).collect()}
    wanted = linked(texts, {})
    assert got.keys() == wanted.keys() and all(got[k][1] == t and got[k][0] == pytest.approx(j) for k, (j, t) in wanted.items())


def test_families_of_all_notes(spark):
    notes = [r for r in rows(spark, "notes") if r.verdict == "fake"]
    sets = {r.event_id: (r.denomination, r.k & 255) for r in notes if r.k & 255}
    kinds = sorted(set(sets.values()))
    near = [(a, b) for a in kinds for b in kinds if a[0] == b[0] and a[1] & b[1]]
    of, place, held = groups(near), {r.event_id: r.district for r in notes}, {}
    for i, kind in sets.items():
        held.setdefault(of[kind], []).append(i)
    held = [v for v in held.values() if len(v) > 1]
    got = correlation.e03_family_summary(spark, SF).first()
    assert tuple(got) == (len(held), sum(map(len, held)), sum(len({place[i] for i in v}) > 1 for v in held))
    assert sorted(r.notes for r in correlation.e02_plate_families(spark, SF).collect()) == sorted(map(len, held))


def test_trails_and_actions_use_detected_rings(spark):
    ring = {r.account_id: r.ring_id for r in rings.k04_ring_members(spark, SF).collect()}
    into = [r for r in rows(spark, "p2p") if r.target in ring and r.source not in ring]
    wanted, scams = {}, rows(spark, "scams")
    for s in scams:
        hits = [(e.t, e.target, e.tx_id) for e in into if s.paid > 0 and abs(e.amount - s.paid) * 100 <= s.paid and -7200 <= e.t - s.t <= 345600]
        if hits:
            wanted[s.event_id] = min(hits)[1:]
    assert ring and wanted and {r.event_id: (r.target, r.tx_id) for r in correlation.j02_money_trails(spark, SF).collect()} == wanted
    district = {r.account_id: r.district for r in rows(spark, "members")}
    places = {(ring[a], district[a]) for a in ring}
    links = {(r.event_id, r.ring_id) for r in correlation.j03_scam_rings(spark, SF).collect()}
    assert links == {(s.event_id, g) for s in scams if s.verdict != "legit" for g, d in places if d == s.district}
    frozen = {r.target for r in records.a01_a02_actions(spark, SF).where("rule = 1").collect()}
    assert frozen == {t for t, _ in wanted.values()}


def test_all_seizures_are_snapped(spark):
    def km(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        return 12742 * math.asin(min(1, math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2)))

    nodes, wanted = networks.nodes(spark, SF).collect(), {}
    for s in (r for r in rows(spark, "notes") if r.verdict == "fake"):
        for n in nodes:
            d = km(s.lat, s.lon, n.lat, n.lon)
            if d <= 60:
                key = s.event_id, n.corridor
                wanted[key] = min(wanted.get(key, (1e9, 0)), (d, n.idx))
    got = {(r.event_id, r.corridor): r.idx for r in networks.w01_snapped(spark, SF).collect()}
    assert got == {k: v[1] for k, v in wanted.items()}
    near = {r.corridor: r.fir for r in networks.w02_w06_trails(spark, SF).collect()}
    clicks = [r for r in rows(spark, "points") if r.event_type == "click"]
    assert near == {c: sum(any(n.corridor == c and km(p.lat, p.lon, n.lat, n.lon) <= 80 for n in nodes) for p in clicks) for c in near} and near
