import math

import corpus_pipeline
from folioforge.llm import packing, quality_rules, secret_scan
from tests.llm.test_near_copies import brute_components
from tests.llm.test_packing import checked
from tests.llm.test_quality_rules import brute as brute_counts
from tests.llm.test_secret_scan import brute as brute_spans

DIR = "/root/testdata/sf0.001"


def brute_quality(rows):
    """Ids that pass, by exact bucket quantiles in plain Python."""
    gamma = (1 + quality_rules.ACCURACY) / (1 - quality_rules.ACCURACY)
    measured = {}
    for r in rows:
        n = dict(zip(quality_rules.COUNTS, brute_counts(r.text), strict=False))
        n["n_upper"] = sum("A" <= c <= "Z" for c in r.text or "")
        ratios = {k: n[a] / n[b] if n[b] else 0.0 for k, (a, b, *_) in quality_rules.RULES.items()}
        measured[r.doc_id] = (r, n, ratios, n["n_words"] < 20 or 100 * n["n_repeat_words"] > 30 * n["n_words"])
    passed = [m for m in measured.values() if not m[3]]

    def quantile(values, p):
        buckets = sorted(-(10**6) if v < 1e-4 else math.ceil(math.log(v) / math.log(gamma)) for v in values)
        b = buckets[math.ceil(len(buckets) * p / 100) - 1]
        return 0.0 if b == -(10**6) else 2 * gamma**b / (gamma + 1)

    def statistics(group, rule, wider):
        values = [m[2][rule] for m in group]
        some = [v for v in values if v >= 1e-4]
        own = [(quantile(values, 25), len(values)), (quantile(values, 75), len(values)), (quantile(some, 90) if some else 0.0, len(some))]
        prior = quality_rules.PRIOR
        return [(v * n + prior * w) / (n + prior) for (v, n), w in zip(own, wider, strict=True)] if wider else [v for v, _ in own]

    kept = set()
    for i, (r, _, ratios, failed) in measured.items():
        if failed:
            continue
        ok = True
        for rule, (_, _, reach, part, two) in quality_rules.RULES.items():
            found = None
            for group in (passed, [m for m in passed if m[0].lang == r.lang], [m for m in passed if (m[0].lang, m[0].source) == (r.lang, r.source)]):
                found = statistics(group, rule, found)
            lo, hi, top = found
            width = max(reach * (hi - lo), part * top)
            ok &= ratios[rule] <= hi + width and (not two or ratios[rule] >= lo - width)
        if ok:
            kept.add(i)
    return kept


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, before = docs.columns, docs.collect()
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DIR)
        out[name] = rows = docs.collect()
        if name != "best_fit_packing":
            assert docs.columns == columns
            docs = spark.createDataFrame(rows, docs.schema)
    quality = {r.doc_id for r in out["quality_rules"]}
    assert quality == brute_quality(before)
    component = brute_components(sorted((r.doc_id, r.text) for r in out["quality_rules"]))
    near = {r.doc_id: r.text for r in out["simhash_near_dedup"]}
    assert set(near) == {k for k, c in component.items() if k == c}
    seen = {}
    for r in sorted(out["substring_dedup"], key=lambda r: r.doc_id):
        words, old = r.text.lower().split(), iter(near[r.doc_id].lower().split())
        assert all(w in old for w in words) and r.n_chars == len(r.text)  # a subsequence
        for j in range(len(words) - 59):
            assert seen.setdefault(tuple(words[j : j + 60]), r.doc_id) == r.doc_id
    cut = {r.doc_id: r.text for r in out["substring_dedup"]}
    assert all(r.text == cut[r.doc_id] for r in out["secret_scans"] if not brute_spans(cut[r.doc_id]))
    assert not any(brute_spans(r.text) for r in out["secret_scans"]) and {r.doc_id for r in out["secret_scans"]} == set(cut)
    texts = [None] * (max(cut) + 1)
    for r in out["secret_scans"]:
        texts[r.doc_id] = r.text
    pieces = out["best_fit_packing"]
    ids = sorted(cut)
    place = {i: k for k, i in enumerate(ids)}
    n, least = checked([type(p)(**{**p.asDict(), "doc_id": place[p.doc_id]}) for p in pieces], [texts[i] for i in ids])
    assert n <= least * 1.02 + 1 and packing.CAPACITY == 2048


def test_run_returns_the_last_stage(spark):
    got = corpus_pipeline.run(spark, DIR)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(got.columns) and got.count() > 0
    assert secret_scan.RULES[0].kind == "assign"
