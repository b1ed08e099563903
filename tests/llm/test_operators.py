"""Each operator against a brute-force version, and on odd rows: nulls, empty and long texts, ties, repeats, clashing columns, no rows."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.llm import chat_format, common, decontaminate, line_dedup, packing, quality_knn, quality_rules, simhash, suffix_dedup, toxicity, url_filter
from strataloom.llm import queries as registered
from strataloom.llm.queries import URL_RULES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _sl_did string, did string, n_lines int, th string"
WORDS = ["the", "of", "and", "to", "in", "is", "house", "river", "stone", "cloud", "Über", "été", "señal", "walks", "sings", "burns", "quick", "brown", "fox", "dog"]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (".\n" if r.random() < 0.08 else "") for _ in range(n))


def odd_rows():
    a, b = prose(1, 150), prose(2, 200)
    shared = prose(3, 60)
    texts = [(1, a), (2, a), (3, b + shared), (4, shared + "\n" + prose(4, 90)), (5, None), (6, ""), (7, "   \n\t\n"), (None, a), (None, None), (8, b), (8, b), (9, b[:-3] + "odd"), (10, "x" * 5000), (11, "ab " * 3000), (12, prose(5, 6000)), (13, "one"), (14, "\n" * 50), (15, "A line of text here\nA LINE of text here  \nother"), (16, "  a line OF text here"), (8, "another row of eight with its own text")]
    return [(i, t, "en" if i else None, None, None, "own", "own", 7, "own") for i, t in texts]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))


# 1 ------------------------------------------------------------------------------------------------------------------


def test_url_rules_and_tree(spark):
    urls = [(1, "https://A.example.ORG/es/1?x"), (2, "http://example.org/en/12"), (3, "ftp://foo.com/de/"), (4, None), (5, "no scheme"), (6, "http://bad.net#x"), (7, "http://orgs/"), (7, "http://orgs/"), (8, "https://b.org?/q")]
    urls += [(100 + i, f"http://spam.net/promo/{i}") for i in range(30)] + [(200 + i, f"http://spam.net/news/{i}.html") for i in range(30)]
    labels = spark.createDataFrame([(100 + i, 1) for i in range(20)] + [(200 + i, 0) for i in range(20)] + [(None, 1)], "page_id long, bad int")
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(urls, "page_id long, url string"), URL_RULES, labels).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert (got[2].rule, got[2].verdict) == ("example.org/en/1", "block")
    assert (got[3].rule, got[3].verdict) == ("com/de/", "block")
    assert got[4].host == got[4].path == got[5].host == "" and got[4].rule is None
    assert (got[6].host, got[6].path, got[6].rule) == ("bad.net", "", None)
    assert got[7].rule is None and got[8].path == "" and got[8].rule is None
    assert {got[i].template for i in range(100, 130)} == {"/promo/*"} and {got[i].verdict for i in range(100, 130)} == {"block"}
    assert {got[i].verdict for i in range(200, 230)} == {"allow"}
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string"), URL_RULES).count() == 0


def test_url_small_folders_of_a_large_host(spark):
    """A folder with a hundredth of its host's urls is judged on its own, whatever the number of its siblings."""
    urls = [(1000 * f + i, f"http://big.net/user{f}x/{i}") for f in range(100) for i in range(30)] + [(500_000 + 1000 * f + i, f"http://worse.net/user{f}x/{i}") for f in range(100) for i in range(30)]
    labels = spark.createDataFrame([(p, int((p < 1000) if p < 500_000 else (p >= 501_000))) for p, _ in urls], "page_id long, bad int")
    got = {r.page_id: (r.template, r.verdict) for r in url_filter.judge(spark.createDataFrame(urls, "page_id long, url string"), [], labels).collect()}
    assert {got[i] for i in range(30)} == {("/user0x/*", "block")} and {got[500_000 + i] for i in range(30)} == {("/user0x/*", "allow")}
    assert {got[1000 * f + i] for f in range(1, 100) for i in range(30)} == {("/*/*", "allow")} and {got[501_000 + 1000 * f + i] for f in range(99) for i in range(30)} == {("/*/*", "block")}


def test_url_branches_without_labels_stay(spark):
    """Merging needs labels that show likeness: folders without any keep their names, and their parent's share."""
    urls = [(100 * f + i, f"http://quiet.net/{folder}/page{'ab'[i % 2]}/{i}") for f, folder in enumerate(("news", "shop", "blog")) for i in range(20)]
    got = {r.page_id: (r.template, r.purity) for r in url_filter.judge(spark.createDataFrame(urls, "page_id long, url string"), []).collect()}
    assert {t for t, _ in got.values()} == {f"/{folder}/page{x}/*" for folder in ("news", "shop", "blog") for x in "ab"} and {p for _, p in got.values()} == {0.5}


def test_url_open_positions(spark):
    """Where nearly every url has a segment of its own, such segments are one branch; frequent ones stay."""
    urls = [(i, f"http://slugs.net/story/some-title-{chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(60)] + [(100 + i, f"http://slugs.net/story/archive/{i}") for i in range(20)]
    got = {r.page_id: r.template for r in url_filter.judge(spark.createDataFrame(urls, "page_id long, url string"), []).collect()}
    assert {got[i] for i in range(60)} == {"/story/*"} and {got[100 + i] for i in range(20)} == {"/story/archive/*"}


def test_url_branches_at_any_depth(spark):
    """Paths of hundreds of segments take as many rounds as they have branchings."""
    deep = "http://deep.net/" + "/".join(f"s{k}x" for k in range(300))
    urls = [(i, f"{deep}/good/x/{i}") for i in range(30)] + [(100 + i, f"{deep}/bad/x/{i}") for i in range(30)] + [(200, deep), (201, "http://one.net/" + "/".join("abcdefghijkl") + "/7"), (202, "http://h/"), (203, "http://h/" + "z" * 20_000)]
    labels = spark.createDataFrame([(i, 0) for i in range(20)] + [(100 + i, 1) for i in range(20)], "page_id long, bad int")
    got = {r.page_id: (r.template, r.verdict) for r in url_filter.judge(spark.createDataFrame(urls, "page_id long, url string"), [], labels).collect()}
    stem = deep.removeprefix("http://deep.net")
    assert len(got) == len(urls) and got[200][0] == stem and got[201][0] == "/" + "/".join("abcdefghijkl") + "/*" and got[202][0] == "/" and got[203][0] == "/" + "z" * 20_000
    assert {got[i] for i in range(30)} == {(f"{stem}/good/x/*", "allow")} and {got[100 + i] for i in range(30)} == {(f"{stem}/bad/x/*", "block")}


def brute_templates(urls, prior=4.0, z=2.0, margin=0.25):
    """(host, path) -> (template, purity) of urls (host, path) -> (labelled, bad), one node at a time."""
    import re

    out = {}
    share_of = lambda rows, up: (sum(b for *_, b in rows) + prior * up) / (sum(l for _, _, l, _ in rows) + prior)  # noqa: E731, E741

    def node(host, name, rows, share):
        alike = 0
        while all(len(r[1]) > alike for r in rows) and len({r[1][alike] for r in rows}) == 1:
            alike += 1
        name = "".join([name, *("/" + s for s in rows[0][1][:alike])])
        rows = [(p, rest[alike:], l, b) for p, rest, l, b in rows]  # noqa: E741
        stop, go = [r for r in rows if not r[1]], [r for r in rows if r[1]]
        for p, *_ in stop:
            out[host, p] = name, share_of(stop, share) if go else share
        if not go:
            return
        kids = {}
        for r in go:
            kids.setdefault(r[1][0], []).append(r)
        n, all_l, all_b = len(go), sum(r[2] for r in go), sum(r[3] for r in go)
        p = sum(len(k) == 1 and s != "" for s, k in kids.items()) / n
        low = (p + z * z / (2 * n) - z * (p * (1 - p) / n + z * z / (4 * n * n)) ** 0.5) / (1 + z * z / n)
        branches = {}
        for s, k in kids.items():
            l, b = sum(r[2] for r in k), sum(r[3] for r in k)  # noqa: E741
            name_ = s
            if s == "*" or (s and len(k) == 1 and low >= 0.5):
                name_ = "*"
            elif s and l and all_l - l:
                q = (all_b + 1) / (all_l + 2)
                gap = abs((b + 0.5) / (l + 1) - (all_b - b + 0.5) / (all_l - l + 1))
                if gap + z * (q * (1 - q) * (1 / l + 1 / (all_l - l))) ** 0.5 <= margin:
                    name_ = "*"
            branches.setdefault(name_, []).extend((p_, rest[1:], l_, b_) for p_, rest, l_, b_ in k)
        for s, k in branches.items():
            node(host, f"{name}/{s}", k, share_of(k, share))

    hosts = {}
    for (host, path), (l, b) in urls.items():  # noqa: E741
        rest = [] if not path else [("*" if re.search(url_filter.VARIABLE, s) else s) for s in path[1:].split("/")]
        hosts.setdefault(host, []).append((path, rest, l, b))
    every = sum(b for _, b in urls.values()), sum(l for l, _ in urls.values())  # noqa: E741
    for host, rows in hosts.items():
        node(host, "", rows, share_of(rows, (every[0] + 0.5) / (every[1] + 1)))
    return out


def test_url_chain_of_branchings_takes_no_rounds(spark, monkeypatch):
    """A crawler's trap: each path goes on where the one before ended."""
    stored = []
    monkeypatch.setattr(url_filter, "store", lambda df, label: stored.append(label) or common.store(df, label))
    rows = [("trap.net", "/a" * k, 1, 1, k % 2) for k in range(1, 201)]
    got = {(x.host, x.path): (x.template, pytest.approx(x.purity)) for x in url_filter.templates(spark.createDataFrame(rows, "host string, path string, n long, labelled long, bad long")).collect()}
    assert got == brute_templates({(h, p): (l, b) for h, p, _, l, b in rows}) and len(stored) <= 3


@pytest.mark.parametrize("local_urls", [0, 6, 10_000])
def test_url_tree_by_brute_force(spark, local_urls):
    r = random.Random(8)
    urls = {}
    for _ in range(700):
        host = r.choice(["a.net", "b.net", "c.org", ""])
        path = "/".join(["", *(r.choice(["en", "de", "shop", "x", "12", "2020-01-02", "", f"slug{r.random()}"][: 4 + r.randrange(5)]) for _ in range(r.randrange(6)))])
        labelled = r.choice([0, 0, 1, 3])
        urls[host, path] = labelled, min(labelled, r.choice([0, 0, 3 if "shop" in path else 1]))
    df = spark.createDataFrame([(*k, 1, *v) for k, v in urls.items()], "host string, path string, n long, labelled long, bad long").repartition(3)
    got = {(x.host, x.path): (x.template, pytest.approx(x.purity)) for x in url_filter.templates(df, local_urls=local_urls).collect()}
    assert len(got) == len(urls) and got == brute_templates(urls)


# 2 ------------------------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    import xxhash

    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, budget=3):
    ids = list(range(len(fps)))
    root = ids[:]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in ids:
        for j in ids[:i]:
            if (fps[i] ^ fps[j]).bit_count() <= budget:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in ids]


def test_simhash_rows(odd, none):
    rows = [(r[0], r[1]) for r in odd_rows()]
    fps = [brute_fingerprint(t) for _, t in rows]
    comp = brute_components(fps)
    least = {c: min((rows[i][0] for i in range(len(rows)) if comp[i] == c and rows[i][0] is not None), default=None) for c in comp}
    want = [(i, f"{f:016x}", least[c]) for (i, _), f, c in zip(rows, fps, comp, strict=True)]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert rows_of(simhash.near_duplicates(odd).select("doc_id", "fingerprint", "component_id")) == sorted(want, key=key)
    kept = simhash.one_of_each(odd)
    whole = {tuple(r) for r in odd_rows()}
    assert kept.dtypes == odd.dtypes and kept.count() == len(set(comp)) and all(tuple(r) in whole for r in kept.collect())
    assert simhash.near_duplicates(none).count() == 0 and simhash.one_of_each(none).count() == 0


@pytest.mark.parametrize("node_rows", [4, 1_000_000])
def test_simhash_links_are_whole(spark, node_rows):
    r = random.Random(5)
    fps = set()
    for _ in range(12):  # dense groups of near copies, some sharing a block
        centre = r.getrandbits(64)
        for _ in range(40):
            x = centre
            for _ in range(r.randrange(5)):
                x ^= 1 << r.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), node_rows=node_rows)
    assert edges.count() <= 8 * len(fps) * (1 if node_rows > 10 else 100)
    root = {x.node: x.root for x in common.components(edges).collect()}
    comp = brute_components(fps)
    mine = [root.get(f, f) for f in signed]
    assert len({(a, b) for a, b in zip(comp, mine, strict=True)}) == len(set(comp)) == len(set(mine))


def test_trie_chunks():
    r = np.random.default_rng(3)
    keys = np.unique(np.uint64(0xABCD << 48) | (np.uint64(1) << r.integers(0, 48, 400).astype(np.uint64)) | (np.uint64(1) << r.integers(0, 48, 400).astype(np.uint64)))
    root = simhash.trie_links(keys, np.zeros(len(keys), int), 3, 47, chunk=50)
    comp = brute_components([int(k) for k in keys])
    assert len({(a, b) for a, b in zip(comp, root.tolist(), strict=True)}) == len(set(comp)) == len(set(root.tolist()))


# 3 ------------------------------------------------------------------------------------------------------------------


def brute_base(text):
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        dup += line in seen and bool(re.search(r"[^\x20\x09-\x0D]", line))
        seen.add(line)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_quality_base(odd, none):
    got = quality_rules.score(odd).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = sorted(((r[0], *brute_base(r[1])) for r in odd_rows()), key=lambda r: tuple((x is None, str(x)) for x in r))
    assert rows_of(got) == want
    assert quality_rules.score(none).count() == 0 and quality_rules.keep(none).count() == 0


def brute_classes(text):
    def kind(c):
        if ord(c) > 127:
            return "beyond"
        for name, chars in (("newline", "\n"), ("blank", " \t\x0b\x0c\r"), ("digit", "0123456789"), ("stop", ".,;:?'\"()-"), ("symbol", "#*$%&|<>")):
            if c in chars:
                return name
        return "lower" if "a" <= c <= "z" else "upper" if "A" <= c <= "Z" else "other"

    return Counter(map(kind, text))


def brute_verdicts(texts):
    """kept of each text, with references of these texts, by the rules as they are said."""
    import math
    import re

    known = {w for ws in quality_rules.COMMON.values() for w in ws}
    of = [(brute_base(t), brute_classes(t or ""), Counter(w if w in known else None for w in re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for t in texts]
    refs = {}
    for base, classes, words in of:
        if not base[5]:
            share = {k: sum(words[w] for w in set(ws)) / base[0] for k, ws in quality_rules.COMMON.items()}
            lang = max(share, key=share.get)
            if share[lang] >= 0.1:
                c, w, n = refs.setdefault(lang, (Counter(), Counter(), [0]))
                n[0] += base[0]
                for total, own in ((c, classes), (w, words)):
                    for k, v in own.items():
                        total[k] += v / sum(own.values())

    def distance(p, q):
        p, q = ({k: v / sum(h.values()) for k, v in h.items()} for h in (p, q))
        half = lambda a, b: sum(v * math.log2(2 * v / (v + b.get(k, 0))) for k, v in a.items() if v)
        return max(0.0, (half(p, q) + half(q, p)) / 2) ** 0.5

    out = []
    for base, classes, words in of:
        kept = not base[5]
        if kept and refs:
            a, b, n = min(((distance(classes, c), distance(words, w), n[0]) for c, w, n in refs.values()), key=lambda x: x[0] + x[1])
            noise = (1 / base[0] + 1 / n) ** 0.5
            told = [(a, quality_rules.CLASSES_AT)] if sum(classes.values()) >= 100 else []
            told += [(b, quality_rules.WORDS_AT)] if base[0] >= 30 else []
            told += [(a + b, quality_rules.SUM_AT)] if len(told) == 2 else []
            kept = all(d <= far + noise * near for d, (far, near) in told)
        out.append(kept)
    return out


def test_quality_divergence(spark, odd):
    r = random.Random(1)
    common_ = quality_rules.COMMON["en"][:30]
    good = [(i, " ".join(r.choice(common_ if r.random() < 0.5 else WORDS) for _ in range(200)), "en") for i in range(60)]
    bad = [(100, " ".join(f"zq{i}x$$$" for i in range(200)), "en"), (101, "short but clean text", "en")]
    edge = [(200 + i, " ".join(r.choice(common_ if r.random() < i / 40 else [f"x{k}|" for k in range(50)]) for _ in range(20 + 2 * i)), None) for i in range(40)]
    mixed = [(300 + i, " ".join(r.choice(quality_rules.COMMON[k][:40]) + r.choice(["", "", ",", ". "]) for _ in range(15 + 9 * i)), "de") for i, k in enumerate(("de", "fr", "es") * 4)]
    df = spark.createDataFrame(good + bad + edge + mixed, "doc_id long, text string, lang string").repartition(5)
    want = {i for (i, _, _), k in zip(good + bad + edge + mixed, brute_verdicts([t for _, t, _ in good + bad + edge + mixed]), strict=True) if k}
    assert {x.doc_id for x in quality_rules.keep(df).collect()} == want == {x.doc_id for x in quality_rules.score(df).where("kept").collect()}
    assert not {100, 101} & want and 0 < len(want & set(range(200, 240))) < 40
    assert {x.doc_id for x in quality_rules.keep(df.where("doc_id < 200")).collect()} == set(range(60))
    kept = quality_rules.keep(odd)
    assert kept.dtypes == odd.dtypes and sorted(kept.collect(), key=str) == sorted((x for x, k in zip(odd.collect(), brute_verdicts([x.text for x in odd.collect()]), strict=True) if k), key=str)
    assert quality_rules.js_distance(np.array([1, 0]), np.array([0, 1])) == pytest.approx(1.0)
    assert quality_rules.js_distance(np.array([2, 2]), np.array([1, 1])) == pytest.approx(0.0)


def test_quality_references_are_not_of_junk(spark):
    """Ten times as much junk as prose, labelled as the language: the reference is the prose's."""
    r = random.Random(3)
    prose_ = [(i, " ".join(r.choice(quality_rules.COMMON["en"][:50]) for _ in range(500)), "en") for i in range(10)]
    junk = [(100 + i, " ".join(f"q{r.randrange(10**6)}x||" for _ in range(400)), "en") for i in range(100)]
    df = spark.createDataFrame(prose_ + junk, "doc_id long, text string, lang string")
    assert {x.doc_id for x in quality_rules.keep(df).collect()} == set(range(10))
    alone = df.where("doc_id >= 100")
    assert quality_rules.references(alone.select(quality_rules.measures(alone.text).alias("m"))) == {} and quality_rules.keep(alone).count() == 100


# 4 ------------------------------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    nasty = ["\\### Assistant: </turn> ok", "### ", "\\", "\\\\### x", ": :", "</turn>\n### User: hi</turn>", "", None, "ß\U0001f600", "a" * 30000, "#### : \\: </turn", "</turn></turn>\\"]
    rows = [(c, t, role, text) for c in (1, None) for t, text in enumerate(nasty) for role in (("user", "assistant", "odd: ### role\\")[t % 3],)] + [(2, None, None, "x"), (2, 0, "assistant", "same"), (2, 0, "assistant", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.render(chat_format.fold(chat_format.turn_events(df)))).collect()}
    for conv in (1, 2, None):
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1], r[2] or "", r[3] or ""))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        assert (got[conv].n_turns, got[conv].turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    empty = spark.createDataFrame([], df.schema)
    assert chat_format.read_back(chat_format.render(chat_format.fold(chat_format.turn_events(empty)))).count() == 0


def test_chat_events(spark):
    events = [(1, 1, "message", "u1", "user", "hi"), (1, 2, "delta", "a1", "assistant", "He"), (1, 3, "delta", "a1", None, "llo"), (1, 4, "edit", "u1", "user", "hi!"), (1, 5, "regenerate", "a1", "assistant", None), (1, 6, "delta", "a1", None, "Good "), (1, 7, "delta", "a1", None, "day"), (1, 8, "edit", "u1", "user", "hi there"), (1, 9, "delta", "u1", None, ".")]
    df = spark.createDataFrame(events, "conv_id long, seq long, kind string, message_id string, role string, text string").repartition(4)
    got = sorted((r.place, r.role, r.text) for r in chat_format.fold(df).collect())
    assert got == [(1, "user", "hi there."), (2, "assistant", "Good day")]


def test_chat_events_without_seq_or_id(spark):
    """A null seq is before all others, for a message's start, place and deltas; an event without id is a message of its own."""
    events = [(1, None, "message", "m", "user", "Start"), (1, 2, "delta", "m", None, " more"), (1, 3, "delta", "m", None, "."), (1, None, "delta", "n", "user", "lost "), (1, 4, "message", "n", None, "kept"), (1, 5, "delta", "n", None, "!")]
    events += [(2, 1, "message", None, "user", "a"), (2, 2, "delta", None, "user", "b"), (2, 3, "edit", None, "user", "c"), (2, 4, "regenerate", None, "user", "d")]
    df = spark.createDataFrame(events, "conv_id long, seq long, kind string, message_id string, role string, text string").repartition(4)
    got = sorted((r.conv_id, r.place or 0, r.role, r.text) for r in chat_format.fold(df).collect())
    assert got == [(1, 0, "user", "Start more."), (1, 0, "user", "kept!"), (2, 1, "user", "a"), (2, 2, "user", "b"), (2, 3, "user", "c"), (2, 4, "user", "")]


def test_chat_deltas_on_the_seq_of_their_message(spark):
    """At one seq (or none), deltas come after what they add to."""
    events = [(1, 1, "message", "m", "user", "a"), (1, 1, "delta", "m", None, "b"), (1, None, "message", "n", "user", "c"), (1, None, "delta", "n", None, "d"), (1, 2, "delta", "n", None, "e"), (1, 3, "regenerate", "o", "user", None), (1, 3, "delta", "o", None, "f"), (1, 2, "delta", "o", None, "lost")]
    df = spark.createDataFrame([(*e, "x", 9) for e in events], "conv_id long, seq long, kind string, message_id string, role string, text string, place string, start int").repartition(4)
    assert sorted((r.place or 0, r.text) for r in chat_format.fold(df).collect()) == [(0, "cde"), (1, "ab"), (2, "f")]


def test_chat_log_is_folded_back(spark):
    """turn_events() streams, edits and regenerates; the fold gives back what was said, from the log in any order."""
    said = ["", None, "a", "ab", "Grüße \U0001f600!" * 30, "x" * 50_000]
    rows = [(c, t, role, text) for c in (1, None) for t, (text, role) in enumerate((x, r) for x in said for r in ("user", "Assistant", None))] + [(2, None, "assistant", "no turn"), (2, (1 << 63) - 1, "assistant", "late")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    log = chat_format.turn_events(df)
    assert {r.kind for r in log.select("kind").distinct().collect()} == {"message", "delta", "edit", "regenerate"}
    got = chat_format.fold(log.orderBy(F.rand(3)))
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(((r.conv_id, None if r.place is None else int(r.place) // 16, r.role, r.text) for r in got.collect()), key=key) == sorted(((c, t, r or "", x or "") for c, t, r, x in rows), key=key)


def test_chat_turns_pass_through_the_fold(spark):
    rows = [(1, 0, "user", "same"), (1, 0, "user", "same"), (None, None, None, None)]
    events = chat_format.turn_events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3))
    assert events.where("message_id IS NULL").count() == 0 and events.select("message_id").distinct().count() == 3
    assert chat_format.fold(events).count() == 3


# 5 ------------------------------------------------------------------------------------------------------------------


def brute_lines(rows):
    first = {}
    up = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(up)
    order = lambda i: common.LAST_ID if i is None else i
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                first[key(line)] = min(first.get(key(line), common.LAST_ID), order(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 10 and first[key(x)] < order(i))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize(("batches", "fanout"), [(1, 2), (5, 2), (4, 3)])
def test_line_dedup(odd, none, batches, fanout):
    got = line_dedup.dedup(odd, batches=batches, fanout=fanout)
    got = [(r.doc_id, r.n_lines_, r.n_dropped, r.text or "") for r in got.collect()]
    key = lambda r: (r[0] is None, str(r))
    assert sorted(got, key=key) == sorted(brute_lines([(r[0], r[1]) for r in odd_rows()]), key=key)
    assert line_dedup.dedup(none).count() == 0


def test_line_dedup_leaves_other_columns(odd):
    """A table's own columns keep names, types and values; ours move out of their way."""
    mine = odd.selectExpr("*", "7.5D AS n_dropped", "'x' AS _SL_gone")
    got = line_dedup.dedup(mine)
    assert got.dtypes == [*mine.dtypes, ("n_lines_", "bigint"), ("n_dropped_", "bigint")]
    rest = [c for c in mine.columns if c != "text"]
    assert rows_of(got.select(*rest)) == rows_of(mine.select(*rest))
    want = [(n, gone) for _, n, gone, _ in brute_lines([(r[0], r[1]) for r in odd_rows()])]
    assert sorted((r.n_lines_, r.n_dropped_) for r in got.collect()) == sorted(want)


def test_line_runs_are_neither_shuffled_nor_sorted(spark):
    """Past the first batch, an anti-join shuffles and sorts the batch alone, however many runs there are."""
    runs = line_dedup.Runs(spark, fanout=3)
    batch = lambda k: spark.range(2000).selectExpr(f"xxhash64(id, {k % 3}) AS h1", f"xxhash64(id, {k % 3}, 1) AS h2", "id AS did")
    for k in range(5):
        runs.add(batch(k))
    assert [len(level) for level in runs.levels] == [2, 1]
    with common.settings(spark, spark__sql__legacy__bucketedTableScan__outputOrdering="true", spark__sql__autoBroadcastJoinThreshold="-1"):
        fresh = batch(0).groupBy("h1", "h2").agg(F.min("did").alias("first"))
        for name, _ in (run for level in runs.levels for run in level):
            fresh = fresh.join(spark.table(name).select("h1", "h2"), ["h1", "h2"], "left_anti")
        plan = fresh._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 3 and plan.count("Exchange") == 1 and plan.count("+- Sort ") + plan.count(":- Sort ") == 1
    assert runs.close().count() == 6000


def test_line_dedup_random(spark):
    r = random.Random(9)
    pool = [f"{'Shared line number'[: r.randrange(3, 18)]} {k}" for k in range(40)]
    rows = [(i, "\n".join(r.choice(pool) if r.random() < 0.6 else f"own line {i} {r.random()}" for _ in range(r.randrange(12)))) for i in range(150)]
    got = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((x.doc_id, x.n_lines, x.n_dropped, x.text) for x in got.collect()) == sorted(brute_lines(rows))


# 6 ------------------------------------------------------------------------------------------------------------------


def pieces_of(rows, capacity):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    out = []
    for i, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out += [(i, k, a, len(ids[a : a + capacity]), zlib.crc32(ids[a : a + capacity].tobytes())) for k, a in enumerate(range(0, len(ids), capacity))]
    return out


def check_places(got, capacity):
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("group_rows", [4, 8192])
def test_packing(spark, odd, none, group_rows):
    rows = [(r[0], r[1]) for r in odd_rows()]
    got = packing.pack(odd, capacity=256, group_rows=group_rows).collect()
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == sorted(pieces_of(rows, 256), key=key)
    n = check_places(got, 256)
    assert n <= -(-sum(r.length for r in got) // 256) + 1
    told = packing.certificate(spark.createDataFrame(got), 256)
    assert told["sequences"] == n and told["bound"] == packing.lower_bound(np.array([r.length for r in got]), 256) and told["over"] == n - told["bound"]
    assert packing.pack(none).count() == 0


def test_encoder_is_the_tokenizer():
    e = packing.Encoder(packing.tokenizer_path())
    for text in ["a.b, c. <|startoftext|> it's DON'T. x'. É.. 3. 3,4 ΣΑΣ. 中. ª. ﬁ, 'S. a'd, ", "\x1c a\x1cb", "", ". , .", "x\x85y z", "İ K Å", "word word, word. Word", "z" * 500]:
        assert e(text) == e.raw(text), text


def test_bounds_hold():
    r = np.random.default_rng(0)
    for _ in range(60):
        lengths = r.integers(1, 101, r.integers(1, 60))
        where, offset, free = packing.best_fit_decreasing(lengths, 100)
        assert packing.lower_bound(lengths, 100) <= len(free)
        assert (np.bincount(where, lengths) + free == 100).all() and (free >= 0).all()
    assert packing.lower_bound(np.array([51] * 7), 100) == 7 and packing.lower_bound(np.array([34] * 5), 100) == 3


# 7 and 9 ------------------------------------------------------------------------------------------------------------


def test_quality_knn(spark, odd, none):
    r = random.Random(2)
    good = [(i, prose(i, 80 + i % 50)) for i in range(200)]
    bad = [(1000 + i, " ".join(r.choice(WORDS).upper() + "!!" for _ in range(80 + i % 50))) for i in range(100)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(None, 1), (5, None)], "doc_id long, quality int")
    model = quality_knn.fit(docs, labels)
    got = {x.doc_id: x.score for x in quality_knn.score(docs, model).collect()}
    held = {x.doc_id for x in docs.where(quality_knn.held_out(docs.doc_id, 3, 1)).collect()}
    assert held == {i for i, _ in good + bad if zlib.crc32(str(i).encode()) % 3 == 1}
    assert all((got[i] >= 0.5) == (i < 1000) for i in held)
    scores = [x.score for x in quality_knn.score(odd, model).collect()]
    assert len(scores) == len(odd_rows()) and all(0 <= s <= 1 for s in scores)
    assert quality_knn.score(none, model).count() == 0
    assert quality_knn.fit(docs, labels.limit(0)) is None and quality_knn.score(docs.limit(2), None).first().score == 0.5


def test_quality_knn_votes(spark):
    """The blocked products against neighbours taken one by one."""
    r = np.random.default_rng(5)
    texts = [(prose(i, 30 + i % 40) if i % 3 else " ".join(f"q{r.integers(99)}x" for _ in range(40))).encode() for i in range(150)] + [None, b"", b"\xff\n"]
    x = np.stack([quality_knn.features(t) for t in texts[:120]])
    y = np.array([int(i % 3 > 0) for i in range(120)])
    model = quality_knn.Model(x, y, 16, 7, 8.0)
    v = [model.project(model.weigh(quality_knn.features(t)[None]))[0] for t in texts]
    want = []
    for a in v:
        near = sorted(((float(a @ b), float(k)) for b, k in zip(model.vectors, model.labels, strict=True)), reverse=True)[:7]
        w = [max(0.0, c) ** 8 for c, _ in near]
        want.append((sum(a * k for a, (_, k) in zip(w, near, strict=True)) + 0.1 * model.prior) / (sum(w) + 0.1))
    assert model.score(texts, block=11) == pytest.approx(np.array(want), abs=1e-4)
    q = quality_knn.leading_directions((z := r.standard_normal((60, 20)) * np.arange(20, 0, -1) ** 2.0).astype(np.float32), 5)
    assert np.abs(q.T @ np.linalg.svd(z)[2][:5].T) == pytest.approx(np.eye(5), abs=1e-2)


def test_quality_knn_is_the_same_however_partitioned(spark):
    """More than 5,000 different words in each of 40 partitions, long ones too: the model hangs on none of this."""
    docs = [(i, " ".join(f"w{'o' * (k % 30)}{i}x{k}" for k in range(260)) + (" !!" if i % 4 else " ok")) for i in range(800)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i, _ in docs], "doc_id long, quality int")
    one, many = quality_knn.fit(df.repartition(1), labels), quality_knn.fit(df.repartition(40), labels)
    assert all((getattr(one, k) == getattr(many, k)).all() for k in ("rarity", "mean", "axes", "vectors", "labels"))
    assert quality_knn.fit(df.limit(0), labels) is None


def test_toxicity(spark, odd, none):
    r = random.Random(4)
    clean = [(i, prose(i, 60)) for i in range(300)]
    toxic = [(1000 + i, prose(i, 40) + " you " + " ".join(f"blarg{r.choice(WORDS)}" for _ in range(4)) + " " + prose(i + 1, 20)) for i in range(80)]
    docs = spark.createDataFrame(clean + toxic, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0) for i, _ in clean] + [(i, 1) for i, _ in toxic], "doc_id long, toxic int")
    machine = toxicity.learn(docs, labels)
    got = {x.doc_id: x.score for x in toxicity.score(docs, machine).collect()}
    assert all((got[i] >= 0.3) == (i >= 1000) for i in got)
    scores = [x.score for x in toxicity.score(odd, machine).collect()]
    assert len(scores) == len(odd_rows()) and all(0 <= s <= 1 for s in scores)
    assert toxicity.score(none, machine).count() == 0
    plain = toxicity.learn(docs, labels.limit(0))
    assert plain.score("you are an idiot.") > plain.score("you are not an idiot.") > plain.score("you are tall.")
    assert plain.score("you idiot.") > plain.score("he said you idiot.") and plain.clauses("you idiot. they moron.")[0] == [1.5, 1.5]


def brute_clauses(text, words, reach=20):
    """Scores of a text's clauses, clause by clause, by the rules as they are said."""
    kinds = [(toxicity.TARGETS, "T"), (toxicity.NEGATIONS, "N"), (toxicity.REPORTS, "R"), (toxicity.THREATS, "H")]
    clauses = []
    for line in text.split("\n"):
        now = []
        for token in line.split():
            w = token.lower().strip(toxicity._STRIP)
            now.append("I" if w in words else next((k for ws, k in kinds if w in ws), "."))
            if token[-1] in ".!?;":
                clauses.append(now)
                now = []
        clauses.append(now)
    out, last, heard = [], None, 0
    for no, clause in enumerate(clauses):
        score, target, denied, told = 0.0, False, 0, False
        for s in clause:
            if s in "IH":
                score += words_of(s) * (1.5 if target else 1) * (0.5 if denied else 1) * (0.6 if told else 1)
            target, told = target or s == "T", told or s == "R"
            denied = 3 if s == "N" else max(0, denied - 1)
        insults = clause.count("I")
        at = {k: [i for i, s in enumerate(clause) if s == k] for k in "HT"}
        aimed = bool(insults and target) or any(abs(i - j) <= 4 for i in at["H"] for j in at["T"])
        if last is not None and no - last > reach:
            heard = 0
        if score and (aimed or insults > 1 or (insults and heard + insults > 2)):
            out.append(score)
        if aimed or insults:
            last, heard = no, 2 if aimed else min(2, heard + insults)
    return out


def words_of(symbol):
    return {"I": 1.0, "H": 0.6}[symbol]


def test_toxicity_grammar(spark):
    """The composed machine against the rules said clause by clause; single words score nothing."""
    plain = toxicity.Machine(dict.fromkeys(toxicity.INSULTS, 1.0), {})
    assert all(plain.clauses(t)[0] == [] for t in ("", "a fool.", "the burn of wood", "fool", "you. fool. it burns", "not a fool; you are tall"))
    assert plain.clauses("fool. you fool. burn them!")[0] == [1.5, 0.6] and plain.clauses("a fool, a clown")[0] == [2.0]
    r = random.Random(6)
    pool = ["fool", "Clown,", "burn", "kill", "you", "them", "not", "never", "said", "wrote", "house", "river", "stone", "of"]
    for _ in range(400):
        text = " ".join(r.choice(pool) + r.choice(["", "", "", ".", "!", ";", "\n"]) for _ in range(r.randrange(60)))
        assert plain.clauses(text)[0] == pytest.approx(brute_clauses(text, set(toxicity.INSULTS))), text
    far = "you fool.\n" + "stone. " * 18 + "fool."
    assert plain.clauses(far)[0] == [1.5, 1.0] and plain.clauses(far.replace("stone. ", "stone. stone. ", 1))[0] == [1.5]
    for harmless in ("fool said the king\n\nand then\n\nyou are nice", "I ate a fool today. The stupid lamp broke.", "burn the wood that lies there by you"):
        assert plain.clauses(harmless)[0] == []


def test_registered_toxicity_and_quality(spark, tmp_path):
    """The thin queries: who is held out, what is predicted, and a row for each document."""
    r = random.Random(8)
    rows = [(i, prose(i, 60) + (" you " + " ".join(f"blarg{r.choice(WORDS)}" for _ in range(4)) if i % 5 == 0 else "")) for i in range(150)] + [(None, "no id"), (151, None), (152, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 != 0), int(i % 5 == 0)) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, parts, part, at in (("op7_quality_knn", 3, 1, 0.5), ("op9_toxicity", 4, 2, 0.3)):
        got = registered.queries()[name](spark, str(tmp_path)).collect()
        assert len(got) == len(rows) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= at) for x in got)
        assert all(x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % parts == part) for x in got)
    held = [x for x in got if x.held_out and x.doc_id < 150]
    assert sum(x.predicted == int(x.doc_id % 5 == 0) for x in held) >= 0.9 * len(held)


def test_registered_url_filter(spark, tmp_path):
    """A page has the labels of the document that its url ends in."""
    spark.createDataFrame([(i, f"http://x.net/{'bad' if i % 2 else 'good'}/{i}.html", "") for i in range(60)] + [(60, None, ""), (61, "http://sub.example.org/es/1", "")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {x.page_id: x for x in registered.op1_url_filter(spark, str(tmp_path)).collect()}
    assert all(got[i].verdict == ("block" if i % 2 else "allow") and got[i].rule is None and got[i].host == "x.net" for i in range(60))
    assert (got[60].host, got[60].path) == ("", "") and (got[61].rule, got[61].verdict) == ("example.org/es/", "block")


def test_of_tied_neighbours_the_first_vote():
    r = np.random.default_rng(3)
    for n in (5, 63, 200):
        cos = r.integers(0, 4, (30, n)) / 4
        near, values = quality_knn.nearest(cos, 16)
        want = np.sort(np.argsort(-cos, axis=1, kind="stable")[:, :16], axis=1)
        assert (np.sort(near, axis=1) == want).all() and (values == np.take_along_axis(cos, near, axis=1)).all()
    x = np.repeat(r.integers(0, 5, (3, quality_knn.features(b"a").shape[0])), 40, axis=0).astype(np.float16)
    model = quality_knn.Model(x, np.tile([1, 0, 0, 0], 30), 4, 10, 2.0)
    first = model.score([b"some text", None])
    assert (first == model.score([b"some text"] * 300)[299]).any() and ((0 <= first) & (first <= 1)).all()


# 8 ------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("how", [{"filter_bits": 6, "chunk": 1}, {}])
def test_decontamination(spark, odd, none, how):
    items = [(1, prose(77, 40)), (2, prose(78, 12)), (3, "just Three words"), (4, None), (5, ""), (None, prose(79, 25)), (2, prose(78, 12))]
    w = items[0][1].split()
    docs = [(1, prose(1, 50) + " " + items[0][1].upper().lower() + " " + prose(2, 900)), (2, "well just three WORDS here"), (3, " ".join(w[:36])), (4, " ".join(w[:25])), (5, prose(3, 30) + " " + items[5][1]), (None, items[1][1]), (6, None)]
    docs = [(i, t if i != 1 else prose(1, 50) + " " + items[0][1] + " " + prose(2, 900)) for i, t in docs]
    want = []
    for i, t in docs:
        words = (t or "").encode().lower().split()
        for j, item in items:
            own = (item or "").encode().lower().split()
            if not own:
                continue
            k = min(5, len(own))
            s = {tuple(own[x : x + k]) for x in range(len(own) - k + 1)}
            n = len(s & {tuple(words[x : x + k]) for x in range(len(words) - k + 1)})
            if n >= 0.8 * len(s) - 1e-9:
                want.append((i, j, len(s), n, n / len(s)))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert rows_of(decontaminate.search(d, b, **how)) == sorted(want, key=key)
    assert sorted(r.doc_id for r in decontaminate.clean(d, b, **how).collect()) == [4, 6]
    left = decontaminate.clean(odd, b.unionByName(spark.createDataFrame([(9, "ONE")], b.schema)))
    assert left.dtypes == odd.dtypes and sorted(map(str, left.collect())) == sorted(str(r) for r in odd.collect() if r.doc_id != 13)
    assert decontaminate.search(none, b).count() == 0
    assert decontaminate.search(d, b.limit(0)).count() == 0 and decontaminate.clean(d, b.limit(0)).count() == len(docs)


# 10 -----------------------------------------------------------------------------------------------------------------


def brute_repeats(rows, length):
    seen = Counter()
    texts = [(i, (t or "").encode()) for i, t in rows]
    for _, t in texts:
        seen.update(t[s : s + length] for s in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for s in range(len(t) - length + 1):
            if seen[t[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        runs = sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(t), sum(gone), runs, hashlib.sha256(bytes(x for x, y in zip(t, gone, strict=True) if not y)).hexdigest()))
    return out


@pytest.mark.parametrize("crowd", [1, 1024])
def test_suffix_dedup(odd, none, crowd):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    want = brute_repeats([(r[0], r[1]) for r in odd_rows()], 200)
    assert rows_of(suffix_dedup.report(odd, crowd=crowd)) == sorted(want, key=key)
    assert suffix_dedup.report(none).count() == 0


@pytest.mark.parametrize("crowd", [2, 9, 1024])
def test_suffix_dedup_random(spark, crowd):
    r = random.Random(12)
    pool = [prose(1000 + k, 90) for k in range(6)]
    rows = []
    for i in range(60):
        t = prose(i, r.randrange(120))
        for _ in range(r.randrange(3)):
            p = r.choice(pool)
            a = r.randrange(150)
            t += p[a : a + r.randrange(190, 330)] + prose(500 + i, r.randrange(40))
        rows.append((i, t))
    got = suffix_dedup.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), crowd=crowd)
    assert rows_of(got) == sorted(brute_repeats(rows, 200), key=lambda r: tuple((x is None, str(x)) for x in r))


def test_suffix_runs_of_empty_partitions(spark):
    """A task without any suffix to give out gives none, on both ways into the merge."""
    wanted = spark.createDataFrame([], "did long, th long, pos int, l int, r int, kh long, ch long")
    keyed = spark.createDataFrame([(1, 2, b"x")], "did long, th long, text binary")
    assert suffix_dedup.suffix_runs(keyed, wanted, 4, 200, 64).count() == 0
    settled = spark.createDataFrame([(1, 2, 2, 0, 136, 0, 200, b"y" * 200)], "core long, sub long, n int, lo int, hi int, l int, r int, ctx binary")
    assert suffix_dedup.context_runs(settled.repartition(3), 4).count() == 2


def test_loser_tree():
    r = random.Random(1)
    runs = []
    for _ in range(7):
        s = sorted(bytes(r.choice(b"ab") for _ in range(r.randrange(12))) for _ in range(r.randrange(25)))
        runs.append([(p, x[p:], x) for x, p in zip(s, suffix_dedup.common_prefixes(s), strict=True)])
    out = list(suffix_dedup.LoserTree([iter(x) for x in runs]))
    assert [s for _, s, _ in out] == sorted(x for run in runs for _, _, x in run) and all(s == x for _, s, x in out)
    assert [p for p, _, _ in out][1:] == suffix_dedup.common_prefixes([s for _, s, _ in out])[1:]
    assert list(suffix_dedup.LoserTree([])) == []


# components and the pipeline ----------------------------------------------------------------------------------------


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 200), (200, 300), (7, 7)] + [(500, 500 + k) for k in range(1, 30)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {200: 100, 300: 100} | {500 + k: 500 for k in range(1, 30)}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    item = " ".join(f"bench{k}" for k in range(15))
    rows = [(i, prose(i, 200)) for i in range(40)] + [(50, prose(3, 200)), (51, prose(4, 199) + " more"), (52, prose(7, 100) + " " + item + " " + prose(8, 100)), (53, "too short"), (54, "same words here " * 100), (55, None)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    want = [r for r, kept in zip(rows, brute_verdicts([r[1] for r in rows]), strict=True) if kept]
    lines = [(i, t) for i, _, _, t in brute_lines([(r[0], r[1]) for r in want])]
    comp = brute_components([brute_fingerprint(t) for _, t in lines])
    one = [lines[i] for i in range(len(lines)) if comp[i] == i]
    left = [(i, t) for i, t in one if item not in t]
    got = pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(pieces_of(left, 4096))
    check_places(got, 4096)
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [c.split()[0] for c in schema.split(", ")]
