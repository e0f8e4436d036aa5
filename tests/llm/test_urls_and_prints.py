import fnmatch
import hashlib
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import op1_urls, op2_simhash, op3_quality
from lodestone.llm.op1_urls import GLOBS, RULES, Automaton, parse


def plain_verdict(url):
    host = path = ""
    if url and "://" in url:
        m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1])
        path = m[2]
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    rule = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, rule and rule.name, rule.verdict if rule else None


def test_urls_against_plain_rules(spark):
    rng = random.Random(1)
    hosts = ["example.org", "a.example.org", "xexample.org", "org", ".org", "EXAMPLE.com", "b.c.com", "net", "", "x.org:80", "é.org"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/19?x", "/fr/a#b", "/de/", "/x.org/y", "?/de/", "/fr", "/a//b://c"]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(300)] + [None, "", "no scheme", "a://", "://org/", "http://x.org/" + "y" * 5000]
    got = op1_urls.filter_urls(spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)], "page_id long, url string, host string")).collect()
    assert len(got) == len(urls)
    for r in got:
        host, path, rule, verdict = plain_verdict(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")
    assert op1_urls.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_automaton_against_fnmatch():
    rng = random.Random(2)
    globs = ["".join(rng.choice("ab*?/") for _ in range(rng.randint(1, 9))) for _ in range(40)] + [g for _, g in GLOBS]
    globs = [re.sub(r"\*{3,}", "**", g) for g in globs]
    urls = ["".join(rng.choice("ab/") for _ in range(rng.randint(0, 12))) for _ in range(200)]
    hit = Automaton([parse(g) for g in globs]).matches([u.encode() for u in urls])
    for k, g in enumerate(globs):
        rx = re.compile("".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(t) or re.escape(t) for t in re.findall(r"\*\*|\*|\?|.", g, re.S)), re.S)
        assert [bool(rx.fullmatch(u)) for u in urls] == hit[:, k].tolist(), (g, fnmatch)


def test_fingerprints_and_successors(spark, odd, rows, empty):
    got = [r.asDict() for r in op2_simhash.fingerprint_edits(odd, part_bytes=3000).collect()]
    order = sorted([(r[0], r[1] or "") for r in rows], key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = []
    for i, (doc_id, text) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        k = len(text) // 3
        changed = text[: len(text) - k] + after[:k]
        a, b, c = map(op2_simhash.fingerprint, (text, changed, after))
        want.append((doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), f"{a:016x}", f"{b:016x}", 1 - (a ^ b).bit_count() / 64, 1 - (a ^ c).bit_count() / 64))
    key = lambda r: tuple(map(str, r))
    assert sorted([tuple(r.values()) for r in got], key=key) == sorted(want, key=key)
    assert op2_simhash.fingerprint_edits(empty).count() == 0


def test_permuted_tables_find_every_pair(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 200, dtype=np.int64)
    near = [int(b) ^ sum(1 << int(i) for i in rng.choice(63, rng.integers(1, 5), replace=False)) for b in base]
    values = [*map(int, base), *near]
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (values[0],)], "print long")
    got = {(r["query"], r["found"]) for r in op2_simhash.near_fingerprints(df, df, radius=3).collect()}
    assert got == {(a, b) for a in values for b in values if a != b and (a ^ b).bit_count() <= 3}


def test_neighbours(spark, odd, rows, empty):
    got = {r["doc_id"]: r for r in op2_simhash.neighbours(odd.where("doc_id is not null"), radius=6).collect()}
    prints = {op2_simhash.fingerprint(r[1] or "") for r in rows if r[0] is not None}
    assert set(got) == {r[0] for r in rows if r[0] is not None and r[0] % 50 == 0}
    for doc_id, text in ((r[0], r[1] or "") for r in rows if r[0] in got):
        near = [d for d in ((op2_simhash.fingerprint(text) ^ p).bit_count() for p in prints) if 0 < d <= 6]
        assert (got[doc_id]["n_near"], got[doc_id]["nearest"]) == (len(near), min(near, default=None))
    assert op2_simhash.neighbours(empty).count() == 0


def test_quality_counts_and_clean_documents(spark, odd, rows, empty, labels):
    got = op3_quality.judge(odd, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        text = r["text"] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        often = Counter(windows)
        hit = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)))
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["n_repeat_words"] == len(hit)
        assert r["base_failed"] == (len(words) < 50 or 100 * len(hit) > 50 * len(words))
        assert not (r["base_failed"] and r["kept"])
    assert op3_quality.judge(empty, None).count() == 0
    assert "lang" in op3_quality.judge(odd, None).columns
    assert op3_quality.judge(odd.withColumnRenamed("kept", "Kept"), None).where("kept").count() >= 0


def test_quality_parts_labels(spark, sf):
    """Held out by parity of the id: most clean labelled documents that pass the base rules stay, most junk goes."""
    docs, marks = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = op3_quality.judge(docs.select("doc_id", "text"), marks.where("doc_id % 2 = 0")).join(marks.where("doc_id % 2 = 1"), "doc_id").where(~F.col("base_failed"))
    kept = {r["quality"]: r["k"] for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert kept[1] >= 0.95 and kept.get(0, 0.0) < kept[1]


def test_near_fingerprints_are_not_broadcast(spark):
    """Spark takes the keys of all tables for as small as the fingerprints they come from; broadcast, they fill the driver."""
    prints = spark.range(2000).select(F.xxhash64("id").alias("print"))
    pairs = op2_simhash.near_fingerprints(prints.where("print % 50 = 0"), prints)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [table" in plan and "Broadcast" not in plan
