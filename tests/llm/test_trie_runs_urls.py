"""The prefix trie, periodic runs and URL filters against brute force, with nulls, empty texts, ties, repeats and no rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from kbspark.llm import periodic_runs, prefix_trie, queries, url_filters

WORDS = r"[^\x20\x09-\x0D]+"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def trie_of(convs):
    """The nodes of ``{conv: [(role, text), ...]}`` by whole prefixes."""
    members = defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
    children = defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    out = []
    for k, m in members.items():
        below = [v for v in members if v[: len(k)] == k]
        ends = ",".join(str(c) for c in m if len(convs[c]) == len(k))
        saved = sum((len(members[v]) - 1) * len(v[-1][1].encode().split()) for v in below if v)
        out.append((m[0], len(k), members[k[:-1]][0] if k else None, len(m), len(children[k]), sum(v not in children or not children[v] for v in below), saved, sha(ends)))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def nodes_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def conversations(seed, n=60):
    rng = random.Random(seed)
    text = lambda: rng.choice(["", "yes", "no\tno", "a b c", "ünder 日本", "a  b c"])
    rows = [(c, t, rng.choice(["user", "bot", None]), rng.choice([text(), text(), None]), "clash", 1) for c in range(-3, n) for t in range(rng.randrange(0, 7))]
    rows += [(100, t, "user", "same", "x", 2) for t in range(5)] + [(101, t, "user", "same", "x", 2) for t in range(5)]
    rows += [(102, None, "user", "first", "x", 2), (102, 0, "user", "second", "x", 2), (None, 0, "user", "lost", "x", 2)]
    rng.shuffle(rows)
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, depth string, fp int"


def plain_turns(rows):
    out = defaultdict(list)
    for c, t, r, x, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        out[c].append((r or "", x or ""))
    return out


@pytest.mark.parametrize("bits", [61, 4, 2])
def test_trie_and_collisions(spark, bits):
    """With few bits of a fingerprint, most groups hold unlike prefixes, and many contents share a hash: all are told apart."""
    rows = conversations(bits)
    got = prefix_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA).repartition(7), bits=bits)
    assert nodes_of(got) == trie_of(plain_turns(rows))


def test_rebuilt_trie(spark):
    alone = next(c for c in range(201, 220) if zlib.crc32(str(c).encode()) % 4)  # without a base, so left without turns
    rows = [*conversations(5, 45), (alone, 0, "user", "gone", "x", 1)]
    numbered, contents = prefix_trie.number_turns(spark.createDataFrame(rows, SCHEMA))
    got = prefix_trie.prefix_trie(*queries.rebuilt_conversations(numbered), contents=contents)
    own, want = plain_turns(rows), {}
    for c in own:
        h, base = zlib.crc32(str(c).encode()) % 4, c - int(np.fmod(c, 20))
        want[c] = own.get(base, [])[:h] + own[c][h:]
    assert any(not v for v in want.values())
    assert nodes_of(got) == trie_of(want)
    texts = {(r["conv_id"], r["depth"]): (r["role"], r["text"]) for r in got.collect()}
    assert texts.pop((-3 if -3 in want else min(want), 0)) == (None, None)
    assert all(t == want[c][d - 1] for (c, d), t in texts.items())


def test_trie_of_ties_repeats_and_nothing(spark):
    """Equal turns of a conversation are put in order by their contents, so copies with ties are one path."""
    rows = [(c, 1, "user", t, "x", 0) for c in (1, 2) for t in ("b", "a", "c", "a")]
    got = nodes_of(prefix_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA)))
    assert [r[:4] for r in sorted(got, key=lambda r: r[1])] == [(1, 0, None, 2), (1, 1, 1, 2), (1, 2, 1, 2), (1, 3, 1, 2), (1, 4, 1, 2)]
    empty = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.conversation_trie(empty).count() == 0
    turnless = prefix_trie.prefix_trie(prefix_trie.number_turns(empty)[0], spark.createDataFrame([(4,), (4,), (9,), (None,)], "conv_id long"))
    assert nodes_of(turnless) == [(4, 0, None, 2, 0, 1, 0, sha("4,9"))]


def test_running_sums_over_borders(spark):
    """One key with most rows spreads over ranges; its sums go on over their borders."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.createDataFrame([(k, i) for k, n in ((1, 3), (2, 5000), (3, 4), (4, 900)) for i in range(n)], "k long, i long").repartition(9)
        one = prefix_trie.running_sums(rows, "k", ["i"], lambda b: np.full(b.num_rows, prefix_trie.PRIME - 2, np.uint64))
        got = one.collect()
        assert len(got) == 5907 and all(r["_kb_sum"] == -2 * (r["i"] + 1) % prefix_trie.PRIME for r in got)
        assert one.inputFiles() and len({r["_kb_sum"] for r in got if r["k"] == 2}) == 5000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_products_modulo_the_prime():
    rng = random.Random(1)
    a, b = ([rng.choice([0, 1, prefix_trie.PRIME - 1, rng.randrange(prefix_trie.PRIME)]) for _ in range(500)] for _ in range(2))
    assert prefix_trie.times(np.array(a, np.uint64), np.array(b, np.uint64)).tolist() == [x * y % prefix_trie.PRIME for x, y in zip(a, b)]
    assert prefix_trie._sums(np.array(a, np.uint64)).tolist() == [sum(a[: i + 1]) % prefix_trie.PRIME for i in range(500)]
    assert prefix_trie._powers(np.array([0, 1, 5, 70000])).tolist() == [pow(prefix_trie.POINT, k, prefix_trie.PRIME) for k in (0, 1, 5, 70000)]


def test_hot_end_goes_through_chunks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 50)
    ends = spark.range(3000).selectExpr("3000 - id as conv_id", "case when id < 2900 then 2L else 3L end as depth", "7L as fp", "'' as path").repartition(5)
    got = {r["depth"]: r["ends_sha256"] for r in prefix_trie.end_digests(ends).collect()}
    assert got == {2: sha(",".join(map(str, range(101, 3001)))), 3: sha(",".join(map(str, range(1, 101))))}


def runs_by_hand(w, shortest=12):
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            a = i
            while i < n - q and w[i] == w[i + q]:
                i += 1
            size = i - a + q
            if i > a and size >= max(shortest, 2 * q) and not any(all(w[x] == w[x + p] for x in range(a, a + size - p)) for p in range(1, q)):
                out.append((a, size, q))
            i = max(i, a + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("near", [256, 8, 4])
def test_runs_at_every_lag(monkeypatch, near):
    """With few near lags, nearly all lags come from recurring blocks."""
    monkeypatch.setattr(periodic_runs, "NEAR", near)
    rng = random.Random(near)
    for _ in range(250):
        alphabet, w = rng.choice([1, 2, 2, 3, 5]), []
        while len(w) < rng.choice([5, 13, 40, 120]):
            w += [bytes([97 + rng.randrange(alphabet)]) for _ in range(rng.randrange(1, 14))] * rng.randrange(1, 6)
        assert [tuple(r) for r in periodic_runs.word_runs(w).tolist()] == runs_by_hand(w), w


def test_runs_with_long_periods():
    rng, w = random.Random(4), []
    while len(w) < 2500:
        w += [bytes([97 + rng.randrange(2)]) for _ in range(rng.randrange(1, 700))] * rng.randrange(1, 4)
    assert [tuple(r) for r in periodic_runs.word_runs(w).tolist()] == runs_by_hand(w)
    long = [b"%d" % (i % 70_000) for i in range(200_000)]  # a text of over a megabyte
    assert periodic_runs.word_runs(long).tolist() == [[0, 200_000, 70_000]]
    assert periodic_runs.word_runs([b"x"] * 100_000).tolist() == [[0, 100_000, 1]]


def test_periodic_runs_rows(spark):
    texts = ["", None, " \n", "one", "a b " * 6, "x " * 11, "x " * 12, "p q r " * 5 + "z " + "u v " * 9, "\u00a0 " * 14, "a b " * 6]
    docs = spark.createDataFrame([(i, t, 7, "y") for i, t in enumerate(texts)] + [(None, "k " * 20, 7, "y"), (3, "k " * 20, 8, "y")], "doc_id long, text string, start int, period string")
    got = periodic_runs.periodic_runs(docs, keep=["start", "period"], keep_runs=True, keep_text=True)
    assert got.columns[-2:] == ["start", "period"] and got.columns.count("start") == 2
    rows = got.collect()
    assert len(rows) == 12
    by_id = {r[0]: r for r in rows if r[0] not in (None, 3)}
    for i, t in enumerate(texts):
        if i == 3:
            continue
        w = (t or "").encode().split()
        want, r = runs_by_hand(w), by_id[i]
        gone = {x for a, n, q in want for x in range(a + q, a + n)}
        left = b" ".join(x for k, x in enumerate(w) if k not in gone).decode()
        best = max(want, key=lambda x: (x[1], -x[0], -x[2])) if want else (None,) * 3
        assert r[1:5] == (len(want), *best) and r[5] == (1000 * best[1] // best[2] if want else None)
        assert r[6] == sha("".join(f"{a},{n},{q}\n" for a, n, q in want)) and r[7] == sha(left) and r["collapsed"] == left
        assert [tuple(x) for x in r["runs"]] == want and tuple(r)[-2:] == (7, "y")
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


def test_planted_periods(spark):
    rng = random.Random(2)
    docs = [(i, rng.choice([None, "", "  ", " ".join(rng.choices("abcdefgh", k=rng.randrange(1, 90)))])) for i in range(1500)] + [(None, "a b")]
    got = {r[0]: r[1] for r in queries.with_periods(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    changed = 0
    for i, t in docs:
        h, w = zlib.crc32(str(i).encode()), (t or "").split()
        if i is not None and h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            w = [w[x] if x < a else w[a + (x - a) % p] for x in range(n)]
            changed += 1
            assert got[i] == " ".join(w)
        else:
            assert got[i] == t
    assert changed > 20


RULES = [("com", "/", "allow"), ("Example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "", "block"), ("a.net", "/x", "allow"), ("a.net", "/x/y", "block"), ("", "", "block"), ("tie.org", "/", "allow"), ("tie.org", "/", "block"), (None, "/", "block")]
URLS = ["http://www.EXAMPLE.com/en/1?q#f", "https://example.com/en/", "http://example.com/en", "http://badexample.com/en/", "http://x.www.example.com/en/a://b", "http://com", "http://com/", "http://b.a.net/xylophone", "http://a.net/x/yes/no", "ftp://net?x", "http://net#/", "a.net/x", "", None, "://", "http:///path", "http://tie.org/1", "http://a.net./x", "http://..com/", "http://user@a.net:80/x", "x://a.net/x\n/y", "http://" + "a." * 3000 + "com/" + "en/" * 30000, "http://example.com/en/"]


def judged(url, rules, default):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:].split("?")[0].split("#")[0]
    known = [(h.lower(), p, v) for h, p, v in rules if h is not None]
    fit = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in known if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, 0, 0, None, default))
    return host, path, best[3], best[4]


@pytest.mark.parametrize("rules", [RULES, RULES[:5], []])
def test_urls(spark, rules):
    pages = spark.createDataFrame([(i % 20, u, "clash", "x") for i, u in enumerate(URLS)] + [(None, "http://a.net/x", "clash", "x")], "page_id long, url string, host string, verdict string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = url_filters.judge_urls(pages, table, default="unknown")
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    want = [(i % 20, *judged(u, rules, "unknown")) for i, u in enumerate(URLS)] + [(None, *judged("http://a.net/x", rules, "unknown"))]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert url_filters.judge_urls(pages.limit(0), table).count() == 0


def test_urls_with_shuffled_rules_and_short_prefixes(spark, monkeypatch):
    """Rules too large to broadcast, and prefixes so short that most meet by chance: the digest and the rule decide."""
    monkeypatch.setattr(url_filters, "PREFIX_DIGITS", 1)
    rng = random.Random(6)
    part = lambda: rng.choice("abc")
    rules = [(".".join(part() for _ in range(rng.randrange(1, 4))), "/" + "/".join(part() for _ in range(rng.randrange(0, 3))), rng.choice(["allow", "block"])) for _ in range(150)]
    urls = ["http://" + ".".join(part() for _ in range(rng.randrange(1, 5))) + "/" + "/".join(part() for _ in range(rng.randrange(0, 4))) for _ in range(400)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = url_filters.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string"))
        assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, got.collect())) == [(i, *judged(u, rules, "allow")) for i, u in enumerate(urls)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_periodic_runs_query(spark, tmp_path):
    """The query on a table of its own, each row against the contract worked out by hand."""
    rng = random.Random(17)
    docs = [(i, rng.choice([None, "", " \t\n", *[" ".join(rng.choices("abc", k=n)) for n in (1, 11, 40, 90)], "x y z " * 9, "  q r " * 8])) for i in range(260)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(docs)
    for i, t in docs:
        h, w = zlib.crc32(str(i).encode()), (t or "").encode().split()
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            w = [w[x] if x < a else w[a + (x - a) % p] for x in range(n)]
        runs, r = runs_by_hand(w), got[i]
        gone = {x for a, n, q in runs for x in range(a + q, a + n)}
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2])) if runs else (None,) * 3
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == sha("".join(f"{a},{n},{q}\n" for a, n, q in runs))
        assert r["collapsed_sha256"] == hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()
    assert sum(r["n_runs"] > 0 for r in got.values()) > 40
