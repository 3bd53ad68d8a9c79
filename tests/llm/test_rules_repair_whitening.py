"""URL filters, conversation repair and whitening against SQL and brute force, with odd rows."""

import glob
import hashlib
import itertools
import math
import os
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.llm import queries, repair, url_filter, whitening


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", ["op11_url_filter", "op12_repair"])
def test_matches_sql(spark, sf_dir, db, name):
    df = queries.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    want = db.execute("select " + ", ".join(cols) + f" from ({queries.SQL[name]})").fetchall()
    assert sorted(map(tuple, df.select(*cols).collect()), key=repr) == sorted(want, key=repr)
    assert df.count() == len(want) > 0


# -- URL filters

RULES = [url_filter.site_rule(v, s) for v, s in queries.OP11_RULES] + [
    url_filter.site_rule("block", "a.org/x"),
    url_filter.site_rule("block", "*.org/"),
    url_filter.site_rule("allow", "b.org"),
    url_filter.site_rule("block", "/only-path/"),
    url_filter.pattern_rule("block", "^casino^"),
    url_filter.pattern_rule("block", "^ads*track^"),
    url_filter.pattern_rule("allow", "^ads^safe^"),
    url_filter.pattern_rule("block", "**"),
]
URLS = [
    None, "", "no scheme/com/", "http://", "HTTP://Example.COM/en/1?x#y", "http://www.example.com/en/", "http://notexample.com/en/", "http://example.com", "http://x.net/es/1", "http://x.net/ES/1",
    "ftp://a.org/xyz", "http://a.org/y", "http://*.org/", "http://b.org?casino", "http://sub.b.org#f", "http://bb.org/", "http://q/only-path/z", "http://casino.q/", "http://my-casino.q", "http://casinos.q/",
    "http://q.q/ads/a/b/track", "http://q.q/ads/tracks", "http://q.q/ads/safe/track/", "http://é.com/\n/x", "http://com", "http://com/", "x://y://com/", "http://" + "a." * 20000 + "com/" + "b/" * 20000, "http://q/" + "ads" * 30000,
]


def brute(url, rules):
    """The parts of a URL and the best rule that fits it, by looking at all."""
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)

    def fits(r):
        if r.host is not None:
            h, p = r.text[: r.host], r.text[r.host :]
            return (not h or host == h or host.endswith("." + h)) and path.startswith(p)
        at = re.escape(r.text).replace(r"\^", "(?:(?<![a-z0-9])(?=[a-z0-9])|(?<=[a-z0-9])(?![a-z0-9])[^a-z0-9]?|[^a-z0-9])").replace(r"\*", "[^\x00]*")
        return len(host + path) > 9999 or re.search(at, (host + path).lower()) is not None

    return host, path, sorted((r for r in rules if fits(r)), key=lambda r: (r.host is None, -len(r.text), -(r.host or 0), r.text))


@pytest.mark.parametrize("wave_bytes", [1, 300, 1 << 20])
def test_rules_are_found(spark, wave_bytes):
    pages = spark.createDataFrame([(i, u, 1, 2) for i, u in enumerate(URLS)] + [(None, "http://q.com/", 1, 2)] * 2, "page_id long, url string, host int, best int").repartition(3)
    rules = [r for r in RULES if r.text != "**"]
    got = url_filter.judge(pages, rules, wave_bytes=wave_bytes, keep=["page_id", "host"])
    assert got.columns == ["page_id", "host", "host_", "path", "rule", "pattern", "verdict"]
    rows = got.collect()
    assert len(rows) == len(URLS) + 2
    for r in rows:
        host, path, fit = brute(URLS[r.page_id] if r.page_id is not None else "http://q.com/", rules)
        assert (r["host_"], r.path) == (host, path)
        best = fit[0] if fit else None
        if len(host + path) < 9999:
            assert (r.rule, r.pattern, r.verdict) == ((best.text, None, best.verdict) if best and best.host is not None else (None, best.text, best.verdict) if best else (None, None, "allow")), r


def test_only_rules_of_the_rarest_token_run(spark):
    rules = sorted(RULES, key=lambda r: r.order)
    addresses = spark.createDataFrame([(u,) for u in ["x.com/en", "y.com/en", "z.com/", "www.example.com/en/"]], "a string")
    counts = url_filter.token_counts(addresses, "a", [t for r in rules for t in r.tokens])
    assert counts["com"] == 4 and counts["en"] == 3 and counts["example"] == 1
    by_token, always = url_filter.index(rules, counts)
    assert {rules[i].text for i in by_token["example"]} == {"example.com/en/", "www.example.com/en/"} and "www" not in by_token  # as rare, but shorter
    assert {rules[i].text for i in always} == {"**", "^ads*track^"}
    assert [rules[i].text for i in url_filter.candidates("z.com/", by_token, [])] == ["com/"]
    # a token at an open end is no token: a.org/x also fits a.org/xyz
    assert url_filter.site_rule("block", "a.org/x").tokens == ["a", "org"] and url_filter.pattern_rule("block", "ads^a*b^c^").tokens == ["c"]


def test_no_urls_and_no_rules(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(none, RULES).count() == 0
    some = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert [tuple(r) for r in url_filter.judge(some, [], default="block").collect()] == [(1, "a.com", "/", None, None, "block")]
    assert url_filter.judge(some, RULES + RULES).first().rule == "com/"


# -- repair

STAY = {".": 0, "~": 3}


def cheapest(symbols):
    """The least (cost, letters) that leaves a legal conversation, by trying everything."""
    best = None

    def go(i, out, cost, letters):
        nonlocal best
        if best and (cost > best[0] or cost == best[0] and letters > best[1][: len(letters)]):
            return
        if i == len(symbols):
            if re.fullmatch("(s?(ua)+)?", out):
                best = min(best or (cost, letters), (cost, letters))
        else:
            initial, fault = symbols[i]
            go(i + 1, out, cost + 4, letters + "D")
            if fault != "!":
                go(i + 1, out + initial, cost + STAY[fault], letters + "K")
                for x in "ua":
                    go(i + 1, out + x, cost + 3 + STAY[fault], letters + "R")
        if len(out) < len(symbols) + 3 and not letters.endswith("III"):
            for x in "ua":
                if re.fullmatch("s?(ua)*u?", out + x):
                    go(i, out + x, cost + 3, letters + "I")

    go(0, "", 0, "")
    return best


def priced(symbols):
    runs = repair.runs_of(symbols)
    letters = roles = ""
    state = repair.NOTHING
    for more, more_roles, state in repair.unroll(runs, state, repair.END):
        letters, roles = letters + more, roles + more_roles
    more, more_roles = repair.finish(state)
    v = repair.END
    for symbol, length in reversed(runs):
        v = repair.advance(symbol, length, v)
    return v[repair.NOTHING], letters + more, roles + more_roles


def test_cheapest_edits_of_all_short_conversations():
    symbols = ["s.", "u.", "a.", "x.", "u~", "a~", "s~", "x!"]
    for n in range(4):
        for some in itertools.product(symbols, repeat=n):
            cost, letters, roles = priced(some)
            assert (cost, letters) == cheapest(some), some
            assert re.fullmatch("(s?(ua)+)?", roles.replace("-", "")) and len(roles) == len(letters)
    rng = random.Random(5)
    for _ in range(60):
        some = [rng.choice(symbols) for _ in range(rng.randint(4, 7))]
        assert priced(some)[:2] == cheapest(some), some


def test_long_runs_are_advanced_by_powers():
    for symbol in ("u.", "a~", "x!", "x."):
        v = repair.END
        for _ in range(1000):
            v = repair.apply(repair.matrix(symbol), v)
        assert repair.advance(symbol, 1000, repair.END) == v
        assert repair.apply(repair.run_matrix(symbol, 1000), repair.END) == v
    some = ["u."] * 300 + ["a."] * 5 + ["x!"] * 200 + ["u~"] * 100
    cost, letters, _ = priced(some)
    assert sum({"I": 3, "D": 4, "R": 3, "K": 0}[x] for x in letters) <= cost and len(letters.replace("I", "")) == len(some)


def by_hand(rows):
    """The report of one conversation, row by row."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, symbols, faults = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        last = text.rstrip(" \t\n\v\f\r")[-1:]
        fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else None
        seen.add((role, text))
        if fault:
            faults[fault] += 1
        symbols.append("x!" if fault in ("blank", "duplicate") else (role[:1] if role[:1] in ("s", "u", "a") else "x") + ("~" if fault else "."))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, letters, roles = priced(symbols)
    out, i = [], 0
    for x, y in zip(letters, roles, strict=True):
        if x != "I":
            i += 1
        if x == "K":
            out.append(f"{rows[i - 1][1]}:{rows[i - 1][2]}")
        elif x in "RI":
            out.append(({"u": "user", "a": "assistant"}[y]) + ":" + (rows[i - 1][2] if x == "R" else ""))
    return gaps, *faults.values(), illegal, cost, letters, hashlib.sha256("\n".join(out).encode()).hexdigest()


def conversations():
    rng = random.Random(3)
    texts = ["yes.", "no", "", " \t", "why? ", "é!\n", "x\u00a0", "long " * 50000 + "."]
    out = [(c, rng.choice([None, *range(12)]), rng.choice(["user", "assistant", "system", "", "User", "umpire"]), rng.choice(texts[:-1] if rng.random() < 0.97 else texts)) for c in [*range(12), None] for _ in range(rng.randint(1, 14))]
    # one with more rows than all others, most of them equal
    return out + [(77, t // 3, "user" if t % 2 else "assistant", "same." if t % 5 else f"text {t}.") for t in range(900)] + [(78, 1, "user", "again.")] * 300


@pytest.mark.parametrize("parts", [1, 7])
def test_reports_of_odd_conversations(spark, parts):
    rows = conversations()
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn int, role string, text string, edit int").repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ids = spark.createDataFrame([(i,) for i in {r[0] for r in rows} | {1000}], "conv_id long")
        edits = repair.repair(turns)
        got = {r[0]: tuple(r[1:]) for r in repair.report(edits, ids).collect()}
        cut = edits.groupBy("conv_id").agg(F.countDistinct(F.shiftright("pos", 33)).alias("n")).where("n > 2").count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert cut == (0 if parts == 1 else cut) and (parts == 1 or cut >= 1)
    convs = {1000: []}
    for c, t, role, text in rows:
        convs.setdefault(c, []).append((t, role, text))
    assert set(got) == set(convs)
    for c, some in convs.items():
        assert got[c] == by_hand(some), c


def test_repaired_rows_and_empty_tables(spark):
    turns = spark.createDataFrame([("c", 3, "assistant", "a."), ("c", 1, None, None), ("c", 2, "system", "s.")], "id string, turn long, role string, text string")
    got = [tuple(r)[1:6] for r in repair.repair(turns, id_column="id", null_text=" ").orderBy("pos", "step").collect()]
    assert [(x, role, text) for _, _, x, role, text in got] == [("D", " ", " "), ("D", "system", "s."), ("I", "user", ""), ("K", "assistant", "a.")] or [x[2] for x in got] == ["D", "K", "I", "K"]
    none = turns.limit(0)
    assert repair.repair(none, id_column="id").count() == 0
    assert [tuple(r) for r in repair.report(repair.repair(none, id_column="id"), turns.select("id"), id_column="id").collect()] == [("c", 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_damage(spark):
    import zlib

    rows = [(i, j, "assistant", "One. Two! Three?") for i in range(20) for j in range(6)] + [(None, None, None, None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(map(tuple, queries.damaged(turns).collect()), key=repr)
    want = []
    for c, t, role, text in rows:
        n = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        row = (c, t, "user" if n == 4 else role, "" if n == 1 else re.sub("[.!?]", "", text) if n == 2 else text)
        want += [] if n == 0 else [row] * (2 if n == 3 else 1)
    assert got == sorted(want, key=repr)


# -- whitening


def check_whitened(rows, vectors, components=16):
    """rows against numpy's eigenvectors of the covariance of the distinct whole-number vectors."""
    x = {i: tuple(math.floor(64 * float(np.float32(v))) + 1_000_000 for v in e) for i, e in vectors.items()}
    fit = np.array(sorted(set(x.values())), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    c = np.array(fit - 1_000_000, float) - np.array([float(s - n * 1_000_000) / n for s in sums])
    cov = c.T @ c / n
    values, q = np.linalg.eigh(cov)
    values, q = values[::-1], q[:, ::-1]
    k = min(components, int((values > 1e-10 * values[0]).sum()))
    assert {(r.vec_id, r.component) for r in rows} == {(i, j + 1) for i in vectors for j in range(k)}
    w = {j: {} for j in range(k)}
    for r in rows:
        assert r.n == n and r.identity_error < 1e-10 and r.deviation == sum((n * a - s) ** 2 for a, s in zip(x[r.vec_id], sums, strict=True))
        assert abs(r.explained - values[r.component - 1] / np.trace(cov)) < 1e-12
        w[r.component - 1][r.vec_id] = r.whitened
    for j in range(k):
        want = {i: float(((np.array(v, float) - 1_000_000) - (np.array(sums - n * 1_000_000, float) / n)) @ q[:, j] / math.sqrt(values[j])) for i, v in x.items()}
        sign = np.sign(sum(want[i] * w[j][i] for i in want))
        assert max(abs(want[i] - sign * w[j][i]) for i in want) < 1e-8


def test_whitening_of_the_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    check_whitened(queries.op13_whitening(spark, sf_dir).collect(), {r.vec_id: r.embedding for r in table.collect()})


def test_whitening_of_odd_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((80, 70)) @ np.diag(np.linspace(1, 3, 70))
    rows = [(i, [float(v) for v in x]) for i, x in enumerate(base)] + [(200 + i, [float(v) for v in base[0]]) for i in range(50)]
    bad = [(300, None), (301, [float("nan")] * 70), (302, [None] + [1.0] * 69), (303, [float("inf")] * 70), (304, [])]
    table = spark.createDataFrame([(i, e, 1) for i, e in rows + bad], "vec_id long, embedding array<float>, n int").repartition(3)
    check_whitened(whitening.whiten(table).collect(), dict(rows))
    # few dimensions, and none with variance left over
    flat = {i: [float(i % 3), float(i % 2), 5.0] for i in range(12)}
    table = spark.createDataFrame(list(flat.items()), "vec_id long, embedding array<float>")
    got = whitening.whiten(table).collect()
    assert {r.component for r in got} == {1, 2}
    check_whitened(got, flat)


def test_whitening_without_variance_and_by_length(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0
    rows = [(1, [1.0]), (2, [3.0]), (3, [1.0, 0.0]), (4, [2.0, 1.0]), (None, [2.0, 1.0])]
    got = whitening.whiten(spark.createDataFrame(rows, schema)).collect()
    assert {r.vec_id: r.n for r in got} == {1: 2, 2: 2, 3: 2, 4: 2, None: 2} and {abs(round(r.whitened, 9)) for r in got} == {1.0}
    huge = spark.createDataFrame([(1, [1e38]), (2, [-1e38])], schema)
    assert {r.deviation for r in whitening.whiten(huge).collect()} == {(1 << 63) - 1}
