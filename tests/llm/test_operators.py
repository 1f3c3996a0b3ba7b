"""Each operator against a brute-force version, over one fixture of awkward rows and driver rows."""

import base64
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from recordloom.llm import bpe, chain_dedup, decontaminate, license_scan, line_dedup, pii, repetition, simhash, token_parquet, url_rules

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
GRAPH = re.compile(r"[^\x20\x09-\x0D]+")
PASSAGE = " ".join(f"shared{i} pas{i * 7}" for i in range(40))
LINE = "one very common line with several words that many documents hold"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def awkward():
    filler = lambda n, k: " ".join(f"w{(i * i + 31 * k + 7 * i * k) % 9973}x{k}" for i in range(n))
    rows = [
        (1, None), (2, ""), (3, " \t\n\r\x0b\x0c "), (4, "MIT License, mit license; MIT  LICENSE. the\u212a mıt"),
        (5, "a@b.com@c.org x_y@d.e.f. 1.2.3.4.5 1.2.300.4 +1 (988) 555-2485 4111 1111 1111 1111 4111-1111-1111-1112"),
        (6, "x" * 5000), (7, "ab " * 3000), (8, filler(300, 1) + "\n" + LINE + "\n" + LINE), (8, filler(300, 1) + "\n" + LINE + "\n" + LINE),
        (9, filler(300, 2) + " " + PASSAGE + "\n" + LINE), (10, filler(200, 3) + "\n" + LINE + "\n" + PASSAGE.upper()), (11, PASSAGE + " " + filler(90, 4)),
        (12, filler(300, 1).replace("w5", "q5") + "\nlast line of it all"), (13, "été ÉTÉ \u2028 漢字 it's 'll 123 £$%#|<>&* \u00a0 \u3000x"),
        (14, "GNU General\nPublic-License cc-by\x00nc Apache  license cc by"), (15, "a b c d e f g h i j\nshort item here"), (None, filler(60, 5)), (16, "\n".join([filler(12, 6)] * 9)),
        (17, 'token = "1eb9c654e721b4f812088970e66a6345cee33dd6" secret: abcdef0123456789abcdef01 +12 é é a@b.c'), (18, "é" * 40 + " 1.1.1.1" * 700),
    ]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select((F.col("doc_id") + 1000).alias("doc_id"), "text")
    made = spark.createDataFrame(awkward(), "doc_id long, text string").union(real)
    # Extra columns whose names operators use inside.
    return made.withColumns({c: F.lit("odd") for c in ("key", "fp", "at", "n", "h", "tokens", "root", "first", "component_id", "words")}).repartition(5).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]


def got(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def test_bpe(docs, rows, empty):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(bpe.VOCABULARY), "rb"))}
    oracle = tiktoken.Encoding("o", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for i, t in rows:
        ids = np.array(oracle.encode_ordinary(t), "<u4")
        want[i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()] += 1
    assert got(bpe.encode_decode(docs, digests=True), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    assert all(bytes(r["decoded"]).decode() == dict(rows)[r["doc_id"]] for r in bpe.encode_decode(docs.where("doc_id in (2, 5, 13)")).collect())
    assert bpe.encode_decode(empty, digests=True).count() == 0


def test_bpe_white_space():
    coder = bpe.loaded(public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN)
    oracle = tiktoken.Encoding("o", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(coder.tokens)}, special_tokens={})
    for c in [*range(0x21), 0x7F, 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]:
        for s in (f"a{chr(c)}b", f"a {chr(c)}b", f"a{chr(c)} {chr(c)}b's", f"{chr(c)}{chr(c)}", f"a  {chr(c)}1 "):
            assert np.frombuffer(coder.encode(s), "<u4").tolist() == oracle.encode_ordinary(s), (c, s)


def license_brute(text):
    words = ALNUM.findall(lower(text))
    places = []
    labels = set()
    for phrase, label in license_scan.PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    more, score = set(), 1.0 if places else 0.0
    lines = [ALNUM.findall(lower(x)) for x in text.split("\n")]
    for name, t in license_scan.TEMPLATES.items():
        size = len(ALNUM.findall(t))
        t = set(ALNUM.findall(t))
        # Lines, and in a text of several lines all windows of the template's length.
        blocks = lines + ([words[i : i + size] for i in range(len(words))] if "\n" in text else [])
        share = max((len(t & set(b)) / len(t) for b in blocks), default=0)
        if share >= license_scan.CONTAINMENT - 1e-9:
            more.add(name)
            score = max(score, share)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | more)), score


def test_license(spark, docs, rows, empty):
    more = spark.createDataFrame([(50, "Released today under MIT license"), (51, "x\nThis work is Licensed under GNU general public license v 3\ny"), (52, "licensed under cc nc 4.0 by"), (53, "released mit")], "doc_id long, text string")
    both = docs.select("doc_id", "text").union(more)
    want = Counter((i, *license_brute(t)) for i, t in rows + [tuple(r) for r in more.collect()])
    columns = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    assert got(license_scan.scan(both), *columns) == want
    assert license_scan.scan(empty).count() == 0
    assert license_scan.scan(docs, {}).count() == len(rows)


def test_license_wrapped(spark):
    """Notices wrapped over lines are found, wherever the breaks are; words too far apart are not."""
    notices = {name: text.split() for name, text in license_scan.TEMPLATES.items() if name in ("bsd", "mpl-2.0", "cc-by-4.0", "mit-text", "bsd-disclaimer")}
    rows, want = [(0, "\n".join(" ".join([w] + ["other"] * 9) for w in notices["bsd"]))], {0: ("", 0.0)}
    for name, ws in notices.items():
        for width in (1, 3, len(ws) // 2):
            d = len(rows)
            rows.append((d, "before it\n# " + "\n# ".join(" ".join(ws[k : k + width]) for k in range(0, len(ws), width)) + "\nafter it"))
            want[d] = (name, 1.0)
    found = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["labels"], r["score"]) for r in found} == want


def contamination_brute(text, items):
    words = ALNUM.findall(lower(text))
    hit, names = set(), set()
    for name, item in items:
        w = ALNUM.findall(lower(item or ""))
        n = min(10, len(w))
        for s in {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else ():
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) == s:
                    hit |= set(range(i, i + n))
                    names.add(str(name))
    return len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


def test_decontaminate(spark, docs, rows, empty):
    real = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    items = [*real[:25], (900, PASSAGE), (901, PASSAGE.replace("shared9 ", "other ")), (902, "Short, ITEM here"), (903, None), (904, ""), (905, "last"), (906, "a b c d e f g h i"), (907, "a b c d e f g h i j"), (907, "a b c d e f g h i j"), (100, LINE)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contamination(docs, bench).withColumn("sha", F.sha2(F.array_join("items", ","), 256))
    want = Counter((i, *contamination_brute(t, items)) for i, t in rows)
    assert sum(v for k, v in want.items() if k[-1]) > 5
    assert got(found, "doc_id", "n_words", "n_hit", "n_items", "sha", "contaminated") == want
    clean = decontaminate.keep_clean(docs, bench)
    assert clean.columns == docs.columns
    assert got(clean, "doc_id") == Counter({(k[0],): v for k, v in Counter({k: v for k, v in want.items() if not k[-1]}).items()})
    assert decontaminate.contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(empty, bench).count() == 0


def fingerprint_brute(text):
    words = GRAPH.findall(lower(text))
    if not words:
        return 0
    k = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_brute(fps):
    label = list(range(len(fps)))
    near = np.bitwise_count(np.array(fps, np.uint64)[:, None] ^ np.array(fps, np.uint64)[None, :]) <= 2
    changed = True
    while changed:
        new = [min(label[j] for j in np.flatnonzero(near[i])) for i in range(len(fps))]
        changed, label = new != label, new
    return label


def test_simhash(docs, rows, empty):
    found = simhash.near_duplicates(docs)
    fps = [fingerprint_brute(t) for _, t in rows]
    label = components_brute(fps)
    least = {}
    for (i, _), c in zip(rows, label, strict=True):
        least[c] = min(least.get(c, i) if least.get(c) is not None else i, i) if i is not None and least.get(c, i) is not None else least.get(c, i)
    want = Counter((i, f"{fp:016x}", least[c]) for (i, _), fp, c in zip(rows, fps, label, strict=True))
    assert got(found, "doc_id", "fingerprint", "component_id") == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    by_label = {}
    for (i, t), c in zip(rows, label, strict=True):
        by_label.setdefault(c, set()).add((i is None, i or 0, t))
    left = Counter((r["doc_id"], r["text"] or "") for r in kept.collect())
    assert all(n == 1 for n in left.values()) and len(left) == len(by_label)
    for (i, t) in left:
        group = next(g for g in by_label.values() if (i is None, i or 0, t) in g)
        assert (i is None, i or 0) == min(group)[:2]
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_large_groups(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = {int(b) for b in base}
    for b in base:
        for _ in range(60):
            x = int(b)
            for bit in rng.integers(0, 64, rng.integers(1, 5)):
                x ^= 1 << int(bit)
            fps.add(x)
    fps |= {int(x) for x in rng.integers(0, 1 << 63, 200, dtype=np.uint64)}
    fps = sorted(fps)
    frame = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps], "fp long")
    label = components_brute(fps)
    want = {}
    for x, c in zip(fps, label, strict=True):
        want.setdefault(c, set()).add(x)
    for group in (4096, 3):  # the second size deals nearly every group out again
        roots = simhash.components(simhash.links(frame, group))
        mine = {}
        for r in roots.collect():
            mine.setdefault(r["root"], set()).add(int(np.int64(r["node"]).astype(np.uint64)))
        assert sorted(map(sorted, mine.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def repetition_brute(text):
    words = GRAPH.findall(text)
    n = len(words)
    longest = [0] * n
    for i in range(n):
        for j in range(i + 1, n):
            k = 0
            while j + k < n and words[i + k] == words[j + k]:
                k += 1
            longest[i], longest[j] = max(longest[i], k), max(longest[j], k)
    cover = lambda least: len({p for i, k in enumerate(longest) if k >= least for p in range(i, i + k)})
    lines = [x for x in text.split("\n") if GRAPH.search(x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(n - 2))
    again = len({p for i in range(n - 2) if windows[tuple(words[i : i + 3])] > 1 for p in (i, i + 1, i + 2)})
    assert again == cover(3)
    failed = n < 50 or 100 * again > 50 * n
    kept = not failed and cover(repetition.REPEAT_WORDS) <= repetition.MAX_COVERED * n and max(longest, default=0) <= repetition.MAX_LONGEST
    # Repeated substrings that some two places can't make longer to the right: each is the longest common prefix of two suffixes.
    shared, code = set(), {w: k for k, w in enumerate(dict.fromkeys(words))}
    at = np.array([code[w] for w in words], np.int64)
    for d in range(1, n):
        same = np.r_[at[:-d] == at[d:], False]
        end = np.flatnonzero(~same)
        size = end[np.searchsorted(end, np.arange(n - d))] - np.arange(n - d)
        shared |= {tuple(words[i : i + size[i]]) for i in np.flatnonzero(size >= repetition.REPEAT_WORDS).tolist()}
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), again, cover(repetition.REPEAT_WORDS), max(longest, default=0), len(shared), failed, kept


def test_repetition(docs, rows, empty):
    some = [(i, t) for i, t in rows if len(t) < 6000]
    want = Counter((i, *repetition_brute(t)) for i, t in some)
    found = repetition.judge(docs.where("coalesce(length(text), 0) < 6000"))
    assert got(found, "doc_id", *repetition.COLUMNS, "base_failed", "kept") == want
    kept = repetition.keep_good(docs)
    assert kept.columns == docs.columns
    assert kept.count() == repetition.judge(docs).where("kept").count()
    assert repetition.judge(empty).count() == 0


def host_path_brute(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    host = re.match(r"[^/?#]*", rest)[0]
    return lower(host), re.match(r"[^?#]*", rest[len(host) :])[0]


def test_url_rules(spark):
    urls = [None, "", "nothing", "http://", "HTTP://A.ORG", "x://Example.ORG/es/1?q=/", "http://www.example.org/en/12", "http://notexample.org/en/12", "https://b.com/fr/x#y", "https://b.com/de/", "https://b.com/de", "a://b\n://c/d?e", "http://org/", "http://x.net?a=b/c"]
    bad = [f"http://s{i % 7}.junk.net/pills/{i}?ref=x" for i in range(60)]
    good = [f"http://s{i % 7}.fine.net/pills/{i}?ref=x" for i in range(60)] + [f"http://s{i}.junk.net/about" for i in range(60)]
    all_ = [*urls, *bad, *good, bad[0]]
    pages = spark.createDataFrame([(i, u, "html") for i, u in enumerate(all_)], "page_id long, url string, tokens string")
    labels = spark.createDataFrame([(i, 0 if u in bad else 1, None) for i, u in enumerate(all_) if i % 3] + [(None, 0, 1)], "doc_id long, quality int, toxic int")
    found = {r["page_id"]: r for r in url_rules.judge(pages, labels).collect()}
    assert len(found) == len(all_)
    for i, u in enumerate(all_):
        host, path = host_path_brute(u)
        fits = [(len(h + p), h + p, v) for v, h, p in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        _, rule, verdict = max(fits, default=(0, None, None))
        r = found[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), u
        assert r["verdict"] == (verdict or ("block" if r["mined"] else "allow"))
        if i >= len(urls):  # pills on junk.net are bad; either token alone isn't sure enough
            assert r["verdict"] == ("block" if u in bad else "allow"), u
    one = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert url_rules.judge(pages, one).where("mined is not null").count() == 0
    assert url_rules.judge(pages.limit(0), labels).count() == 0


def test_mined_rules_are_exact(spark):
    rng = np.random.default_rng(1)
    rows_ = [(i, sorted({f"t{x}" for x in rng.integers(0, 8, 4)}), bool(rng.random() < 0.4)) for i in range(300)]
    rows_ = [(i, t, bad or ("t1" in t and "t2" in t)) for i, t, bad in rows_]
    mined = {tuple(r["tokens"]): (r["support"], r["confidence"]) for r in url_rules.mine(spark.createDataFrame(rows_, "id long, tokens array<string>, bad boolean"), 0.02, 0.7, 6, 1.0).collect()}
    from itertools import combinations

    sure = {}
    for k in range(1, 9):
        for s in combinations(sorted({x for _, t, _ in rows_ for x in t}), k):
            have = [bad for _, t, bad in rows_ if set(s) <= set(t)]
            if sum(have) >= 6 and sum(have) >= 0.7 * len(have):
                sure[s] = (sum(have) / 300, sum(have) / len(have))
    assert mined and set(mined) <= set(sure)
    assert all(mined[s] == pytest.approx(sure[s]) for s in mined)
    assert all(any(set(m) < set(s) and sure[m][1] >= sure[s][1] for m in sure) for s in set(sure) - set(mined))


def test_url_rules_on_driver_tables(spark):
    """Rules are mined, and each page that no fixed rule judges is blocked if and only if it has all tokens of one."""
    sf = "/root/testdata/sf0.1"
    pages, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("pages", "labels"))
    found = url_rules.judge(pages, labels).collect()
    urls = {r["page_id"]: r["url"] for r in pages.collect()}

    def tokens(url):
        host, path = host_path_brute(url)
        query = re.match(r"[^?#]*\?([^#]*)", url or "")
        keys = [re.match("[^=]*", x)[0] for x in re.split("[&;]", query[1])] if query else []
        return {f"{k}:{x}" for k, part in (("h", host.split(".")), ("p", path.split("/")), ("q", keys)) for x in part if x}

    bad = {r["doc_id"]: r["quality"] == 0 or r["toxic"] == 1 for r in labels.collect()}
    known = [(tokens(urls[r["page_id"]]), r["verdict"] == "block" if r["rule"] else bad[r["page_id"]]) for r in found if r["rule"] or r["page_id"] in bad]
    base = sum(b for _, b in known) / len(known)
    mined = {tuple(r["mined"].split(" ")) for r in found if r["mined"]}
    assert mined
    for rule in mined:
        have = [b for t, b in known if set(rule) <= t]
        assert sum(have) >= max(url_rules.LEAST, round(url_rules.SUPPORT * len(known))) and sum(have) >= max(url_rules.CONFIDENCE, url_rules.LIFT * base) * len(have)
    free = [r for r in found if not r["rule"]]
    assert all((r["verdict"] == "block") == any(set(rule) <= tokens(urls[r["page_id"]]) for rule in mined) for r in free)
    assert sum(r["verdict"] == "block" for r in free) > 10


def test_url_parts(spark):
    """Of a URL with many tokens every three are together in a part of at most BASKET."""
    from itertools import combinations

    for n in (3, 12, 13, 16, 21):
        items = [f"t{k}" for k in range(n)]
        found = spark.createDataFrame([(items,)], "items array<string>").select(url_rules.parts(F.col("items")).alias("p")).first()["p"]
        assert all(len(p) <= url_rules.BASKET for p in found)
        assert all(any(set(c) <= set(p) for p in found) for c in combinations(items, min(3, n)))


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def pii_brute(text):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for k, (kind, p) in enumerate(kinds.items()):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False, "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def test_pii(docs, rows, empty):
    found = pii.detect(docs)
    want = Counter()
    for i, t in rows:
        b = pii_brute(t)
        want[(i, *(sum(x[3] == k for x in b) for k in ("email", "ip", "card", "phone")), ",".join(f"{k}:{s}:{e}" for s, _, e, k in b))] += 1
    assert got(found, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_spans") == want
    for r in found.collect():
        spans = [(int(s), int(e)) for _, s, e in (x.split(":") for x in r["spans"].split(",") if x)]
        assert spans == sorted(spans, key=lambda x: x[0])
        assert set(filter(None, r["base_spans"].split(","))) <= set(filter(None, r["spans"].split(",")))
    assert pii.detect(empty).count() == 0


def spans_by_python(docs):
    """spans of detect(), with the trees and the limits applied in Python to the candidates."""
    found = pii.candidates(docs)
    trees, limits = pii.fit(found)
    out, added = Counter(), Counter()
    for r in found.collect():
        base = {(b["start"], b["kind"], b["end"]) for b in r["base"]}
        extra = set()
        for c in r["wide"]:
            free = all(c["end"] <= s or e <= c["start"] for s, _, e in base)
            assert free == c["free"]
            if free and c["kind"] in limits and trees.scores(np.array([[c[f] for f in pii.FEATURES]]))[0] >= limits[c["kind"]]:
                extra.add((c["start"], c["kind"], c["end"]))
        for x in extra:
            added[pii.KINDS[x[1]]] += 1
        out[r["doc_id"], ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in sorted(base | extra)), len(base | extra), len(extra)] += 1
    return out, added


def pii_texts():
    """Texts with personal data in forms that the base patterns miss, some after a word that marks them, and look-alikes."""
    rng = np.random.default_rng(5)
    n = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    w = lambda k: " ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(k))
    forms = {
        "phone": lambda: f"({n(3)}) {n(3)}-{n(4)}", "email": lambda: f"{w(1)} [at] {w(1)} [dot] com",
        "secret": lambda: "".join(rng.choice(list("0123456789abcdef"), 40)), "card": lambda: f"{n(4)}.{n(4)}.{n(4)}.{n(4)}",
    }
    marks = {"phone": "call ", "email": "contact: ", "secret": "api_key = '", "card": "card no. "}
    texts, want = [], Counter()
    for i in range(400):
        parts = [w(8)]
        for kind, form in forms.items():
            if rng.random() < 0.3:
                parts += [marks[kind] + form() + ("'" if kind == "secret" else "")]
                want[kind] += 1
            parts += [w(3)]
        parts += [n(8), "pppppppppp" * 3, w(2), f"a{n(9)}b", w(1)]
        texts.append((i, " ".join(parts)))
    return texts, want


def test_pii_added_spans(spark, docs):
    """What the trees add is what they add in Python, of several kinds, at a recall and a precision of 0.9 or more, look-alikes aside."""
    texts, want = pii_texts()
    made = spark.createDataFrame(texts, "doc_id long, text string")
    columns = ("doc_id", "spans", "n_spans", "n_added")
    by_hand, added = spans_by_python(made)
    assert got(pii.detect(made), *columns) == by_hand
    assert set(added) >= {"phone", "email", "secret", "card"}
    assert all(0.9 * want[k] <= added[k] <= want[k] / 0.9 for k in want), (added, want)
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    by_hand, added = spans_by_python(real)
    assert got(pii.detect(real), *columns) == by_hand
    secrets = Counter((r["doc_id"], f"secret:{m.start(1)}:{m.end(1)}") for r in real.collect() for m in re.finditer('(?i)token = "([0-9a-f]{40})"', r["text"] or ""))
    found = Counter((r["doc_id"], s) for r in pii.detect(real).collect() for s in r["spans"].split(",") if s.startswith("secret"))
    assert secrets and secrets == found


def test_redacted(spark):
    one = spark.createDataFrame([("é a@b.c, x 1.2.3.4",)], "text string").withColumn("doc_id", F.lit(1))
    spans = pii.detect(one).first()["base_spans"]
    assert one.select(pii.redacted(F.col("text"), F.lit(spans)).alias("x")).first()["x"] == "é [email], x [ip]"


def aligned_brute(a, b):
    """Places (i, j) of a patience alignment, from its definition: equal ends, then the longest increasing set of
    lines once in both (by trying all earlier ones as the one before; on a tie the one that ends first in b), then the gaps in the same way."""
    if not a or not b:
        return []
    if a[0] == b[0]:
        return [(0, 0)] + [(i + 1, j + 1) for i, j in aligned_brute(a[1:], b[1:])]
    if a[-1] == b[-1]:
        return aligned_brute(a[:-1], b[:-1]) + [(len(a) - 1, len(b) - 1)]
    once = [(i, b.index(x)) for i, x in enumerate(a) if a.count(x) == 1 and b.count(x) == 1]
    if not once:
        return []
    best, rank = [], lambda x: (len(x), -x[-1][1])
    for n, (i, j) in enumerate(once):
        before = max((best[m] for m in range(n) if once[m][1] < j), key=rank, default=[])
        best.append([*before, (i, j)])
    out, p, q = [], 0, 0
    for i, j in [*max(best, key=rank), (len(a), len(b))]:
        out += [(p + x, q + y) for x, y in aligned_brute(a[p:i], b[q:j])]
        out += [(i, j)] if i < len(a) else []
        p, q = i + 1, j + 1
    return out


def cut_brute(t, u):
    """Numbers of t's lines in common blocks of five words or more with u, aligned over the lines that both have."""
    sides = [[(at, no, x) for at, (no, x) in enumerate((n, x) for n, x in enumerate(s.split("\n")) if GRAPH.search(x))] for s in (t, u)]
    both = {x for _, _, x in sides[0]} & {x for _, _, x in sides[1]}
    a, b = ([p for p in side if p[2] in both] for side in sides)
    out, block = set(), []
    for i, j in [*aligned_brute([x for *_, x in a], [x for *_, x in b]), (None, None)]:
        if block and (i is None or (a[i][0], b[j][0]) != (a[block[-1][0]][0] + 1, b[block[-1][1]][0] + 1)):
            if sum(len(GRAPH.findall(a[k][2])) for k, _ in block) >= 5:
                out |= {a[k][1] for k, _ in block}
            block = []
        block.append((i, j))
    return out


def lines_brute(rows):
    """Deletions by alignment with all earlier documents that share a line."""
    texts = sorted({(i, t) for i, t in rows if i is not None})
    words = {x: {y for y in x[1].split("\n") if GRAPH.search(y)} for x in texts}
    out = {}
    for n, x in enumerate(texts):
        for y in texts[:n]:
            if y[0] < x[0] and words[x] & words[y] and (cut := cut_brute(x[1], y[1])):
                out.setdefault(x, set()).update(cut)
    return out


def test_line_dedup(docs, rows, empty):
    cut = lines_brute(rows)
    assert len(cut) > 5
    found = line_dedup.report(docs)
    want = Counter()
    for i, t in rows:
        gone = cut.get((i, t), set())
        left = "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone)
        want[i, len(t.split("\n")), len(gone), tuple(sorted(gone)), hashlib.sha256(left.encode()).hexdigest()] += 1
    mine = Counter((r["doc_id"], r["n_lines"], r["n_deleted"], tuple(r["deleted"]), r["text_sha256"]) for r in found.collect())
    assert mine == want
    new = line_dedup.dedup(docs)
    assert new.columns == docs.columns and new.count() == len(rows)
    assert line_dedup.report(empty).count() == 0
    # Every line with a word stays somewhere.
    before = {x for _, t in rows for x in t.split("\n")}
    assert before == {x for r in new.collect() for x in (r["text"] or "").split("\n")} | (before & {""})


def test_line_dedup_pairs_by_runs(spark):
    """A block of short lines goes from its later copy though each line stands earlier elsewhere, and lines that their
    first holder has out of order go by an earlier copy that has them in order: as by alignment with all earlier documents."""
    block = [f"item {k}" for k in range(7)]
    long = [f"a long line {k} of seven words" for k in range(3)]
    texts = {k: f"{x}\nonly in {k}" for k, x in enumerate(block)}
    texts |= {20: "\n".join(["begin", *block, "end of twenty"]), 21: "\n".join(["other start", *block, "other end"])}
    texts |= {30: "\n".join([long[1], long[0], long[2]]), 31: "\n".join(["x", *long, "y"]), 32: "\n".join(["z", *long, "w"])}
    want = {d: sorted({n for e, u in texts.items() if e < d for n in cut_brute(t, u)}) for d, t in texts.items()}
    assert want[21] == list(range(1, 8)) and want[32] == [1, 2, 3]
    found = line_dedup.report(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["deleted"] for r in found} == want


def test_patience():
    assert line_dedup.patience([1, 2, 3, 4], [9, 2, 3, 8]) == [(1, 1), (2, 2)]
    assert line_dedup.patience([1, 2, 3], [1, 5, 3]) == [(0, 0), (2, 2)]
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = (rng.integers(0, 6, rng.integers(0, 12)).tolist() for _ in "ab")
        pairs = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))


def test_chain_dedup_rows_of_one_id_and_of_none(spark):
    """Equal ids with several texts don't mix, null ids are members of classes, and words are counted without blanks at the ends."""
    rng = np.random.default_rng(9)
    one, two, three, short = prose(rng, 80), prose(rng, 90), prose(rng, 70), prose(rng, 48)
    rows = [(1, " ".join(one + prose(rng, 40))), (1, " ".join(two + prose(rng, 300))), (2, " ".join(prose(rng, 10) + one)), (3, " ".join(prose(rng, 20) + two))]
    rows += [(None, " ".join(three)), (7, " ".join(three)), (8, f"  {' '.join(short)}  "), (9, f"  {' '.join(short)}  "), (None, None), (None, "")]
    found = chain_dedup.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = {(1, 0, 80, 2, 10, 90), (2, 10, 90, 1, 0, 80), (1, 0, 90, 3, 20, 110), (3, 20, 110, 1, 0, 90), (None, 0, 70, 7, 0, 70), (7, 0, 70, None, 0, 70)}
    assert {(r["doc_id"], r["start"], r["end"], r["partner_id"], r["partner_start"], r["partner_end"]) for r in found} == want and len(found) == 6


def planted(rng, share, words, others):
    """Two texts with a passage of so many words, a share of them other words in the second, and others that hold parts of it."""
    one = prose(rng, words)
    two = [w if keep else x for w, x, keep in zip(one, prose(rng, words), rng.random(words) >= share, strict=True)]
    texts = [prose(rng, 60) + one + prose(rng, 60), prose(rng, 30) + two + prose(rng, 90)]
    for _ in range(others):
        n = int(rng.integers(20, 40))
        at = int(rng.integers(0, words - n + 1))
        texts.append(prose(rng, 50) + one[at : at + n] + prose(rng, 50))
    return [" ".join(t) for t in texts]


def test_chain_dedup_recall_of_changed_passages(spark):
    """Share of planted pairs linked, by identity, length and the number of other texts that hold parts of the passage (README)."""
    rng = np.random.default_rng(21)
    cases = {(0.1, 60, 0): 0.9, (0.15, 200, 0): 0.95, (0.05, 60, 4): 0.9, (0.05, 60, 16): 0.6, (0.0, 61, 16): 1.0}
    rows, pairs = [], {}
    for case in cases:
        for _ in range(30):
            texts = planted(rng, *case)
            pairs.setdefault(case, []).append((len(rows), len(rows) + 1))
            rows += [(len(rows) + k, t) for k, t in enumerate(texts)]
    link = {}
    for r in chain_dedup.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        link.setdefault(r["doc_id"], set()).add(r["partner_id"])

    def reached(a, b):
        seen, todo = {a}, [a]
        while todo:
            new = link.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        return b in seen

    found = {case: sum(reached(a, b) for a, b in ps) / len(ps) for case, ps in pairs.items()}
    assert all(found[case] >= least for case, least in cases.items()), found


def linked(spark, rows):
    """For each id the least one that finds link it to, directly or over others."""
    root = {d: d for d, _ in rows}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in chain_dedup.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        a, b = sorted((top(r["doc_id"]), top(r["partner_id"])))
        root[b] = a
    return {d: top(d) for d in root}


def test_chain_dedup_links_pairs_without_rare_seeds(spark):
    """All seeds of a changed passage are in far more than RARE texts, none of which shares enough with either holder."""
    rng = np.random.default_rng(33)
    rows, pairs = [], []
    for _ in range(20):
        texts = planted(rng, 0.05, 60, 40)
        pairs.append((len(rows), len(rows) + 1))
        rows += [(len(rows) + k, t) for k, t in enumerate(texts)]
    root = linked(spark, rows)
    assert sum(root[a] == root[b] for a, b in pairs) >= 19


def test_chain_dedup_links_passages_that_repeat_themselves(spark):
    """Texts share words that repeat every two words, so that their seeds match at very many places."""
    rng = np.random.default_rng(34)
    rows = [(d, " ".join(prose(rng, 40 + d) + ["is", "so."] * (60 + d) + prose(rng, 50))) for d in range(12)]
    assert set(linked(spark, rows).values()) == {0}


def test_chain_dedup_leaves_linked_pairs_alone(spark, monkeypatch):
    """Pairs share a passage of their own and one that all texts share: finds link these, so no seeds are brought together again."""
    rng = np.random.default_rng(35)
    both = prose(rng, 80)
    own = [prose(rng, 70) for _ in range(15)]
    rows = [(d, " ".join(prose(rng, 40) + both + prose(rng, 20) + own[d // 2] + prose(rng, 30))) for d in range(30)]
    sizes, stored = {}, chain_dedup.stored

    def counted(df, name):
        out = stored(df, name)
        sizes[name] = max(sizes.get(name, 0), out.count())
        return out

    monkeypatch.setattr(chain_dedup, "stored", counted)
    assert set(linked(spark, rows).values()) == {0}
    assert sizes["chain-seeds"] > 0 and sizes["chain-pairs"] > 0 and sizes["chain-common"] == 0


def test_chain_dedup_lists_are_rows():
    """Lists of places stand for rows of matches."""
    rows = [(9, 1, 5, 7, False, None), (9, 2, None, 8, False, [1, 4, 6]), (8, 2, 3, None, True, [2]), (8, 1, 0, 0, True, None)]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.int32())]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["a", "b", "i", "j", "long", "ats"])
    found = [tuple(r.values()) for r in chain_dedup._listed(batch).to_pylist()]
    assert found == [(9, 1, 5, 7, False), (9, 2, 1, 8, False), (9, 2, 4, 8, False), (9, 2, 6, 8, False), (8, 2, 3, 2, True), (8, 1, 0, 0, True)]


def test_chains_in_order_are_optimal():
    """Matches of which each precedes all later ones: each is in one chain at most, and the best score is the best of all."""
    rng = np.random.default_rng(8)
    for _ in range(100):
        n = int(rng.integers(2, 40))
        i, j = (np.cumsum(rng.integers(1, int(rng.choice([5, 30, 60])), n)) for _ in range(2))
        found = chain_dedup.chains(i, j)
        ends = sorted((a, b) for a, b, _, _ in found)
        assert all(b < c for (_, b), (c, _) in zip(ends, ends[1:]))
        score = lambda a, b: 1 + sum(1 - chain_dedup.GAP_COST * (i[k] - i[k - 1] + j[k] - j[k - 1]) for k in range(1, n) if a < i[k] <= b)  # noqa: B023, E731
        assert abs(max([1.0, *(score(a, b) for a, b in ends)]) - chains_brute(i.tolist(), j.tolist())) < 1e-9


def chains_brute(i, j):
    both = sorted(set(zip(i, j)))
    score = {}
    for p, q in both:
        score[p, q] = 1 + max([0.0] + [s - chain_dedup.GAP_COST * (p - x + q - y) for (x, y), s in score.items() if x < p and y < q])
    return max(score.values())


def test_chains_are_optimal():
    rng = np.random.default_rng(7)
    for _ in range(100):
        n = int(rng.integers(2, 40))
        i, j = rng.integers(0, 60, n), rng.integers(0, 60, n)
        best = chains_brute(i.tolist(), j.tolist())
        found = chain_dedup.chains(i, j)
        assert all(a < b and c < d for a, b, c, d in found)
        assert (best > 1.0) == bool(found) or best <= 1.0 + 1e-9


def test_chain_dedup(spark, docs, rows, empty):
    found = chain_dedup.repeated(docs.where("doc_id < 100 or doc_id is null")).collect()
    flagged = {r["doc_id"] for r in found}
    assert {9, 11} <= flagged and {8, 12} <= flagged
    assert not flagged & {1, 2, 3, 4, 5, 13, 14, 15, None}
    span = next(r for r in found if r["doc_id"] == 11 and r["partner_id"] == 9)
    assert (span["start"], span["end"], span["identity"]) == (0, 80, 1.0)
    fuzzy = PASSAGE.split()
    for k in range(5, 80, 17):
        fuzzy[k] = "changed"
    filler = lambda k: " ".join(f"y{k}z{i}" for i in range(150))
    more = spark.createDataFrame([(k, filler(k) + " " + " ".join(fuzzy if k % 2 else PASSAGE.split()) + " " + filler(k + 50)) for k in range(20)] + [(30, filler(30)), (31, filler(31))], "doc_id long, text string")
    found = chain_dedup.repeated(more).collect()
    assert {r["doc_id"] for r in found} == set(range(20))
    assert all(r["end"] - r["start"] >= 60 for r in found)
    # Fewer rows than pairs: a seed of more than RARE texts meets two of them.
    assert len(found) < 20 * 19 / 2
    assert chain_dedup.repeated(empty).count() == 0


def prose(rng, n):
    return [f"t{x}" for x in rng.integers(0, 10**9, n)]


def test_chain_dedup_links_pairs_between_the_ends(spark):
    """Two documents share 80 words; the first and last holders of either half are other documents."""
    rng = np.random.default_rng(3)
    shared = prose(rng, 80)
    parts = {10: shared, 11: shared, 1: shared[:40], 90: shared[:40], 2: shared[40:], 91: shared[40:]}
    rows = [(d, " ".join(prose(rng, 60) + part + prose(rng, 60))) for d, part in parts.items()]
    found = chain_dedup.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["partner_id"], r["start"], r["end"]) for r in found} == {(10, 11, 60, 140), (11, 10, 60, 140)}


def test_chain_dedup_against_brute_force(spark):
    """Texts pieced together from a pool: whatever two of them share in LONG + LONG_GAP - 1 or more
    consecutive words, finds link, directly or over others; and no find is of texts that share nothing."""
    rng = np.random.default_rng(11)
    pool = [prose(rng, 100) for _ in range(12)]
    texts = {}
    for d in range(60):
        words = prose(rng, 30)
        for _ in range(int(rng.integers(0, 4))):
            one, two = pool[int(rng.integers(0, 12))], pool[int(rng.integers(0, 12))]
            lo, hi = int(rng.integers(0, 40)), int(rng.integers(40, 100))
            words += one[lo:] + two[:hi] + prose(rng, 30)
        texts[d] = words
    least = chain_dedup.LONG + chain_dedup.LONG_GAP - 1
    holders = {}
    for d, words in texts.items():
        for k in range(len(words) - least + 1):
            holders.setdefault(tuple(words[k : k + least]), set()).add(d)
    shared = {(a, b) for group in holders.values() for a in group for b in group if a < b}
    assert len(shared) > 20
    rows = [(d, " ".join(words)) for d, words in texts.items()]
    found = chain_dedup.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    root = list(range(60))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in found:
        x, y = texts[r["doc_id"]][r["start"] : r["end"]], texts[r["partner_id"]][r["partner_start"] : r["partner_end"]]
        assert min(len(x), len(y)) >= 50 and len(set(x) & set(y)) >= 0.8 * 50
        root[top(r["doc_id"])] = top(r["partner_id"])
    assert all(top(a) == top(b) for a, b in shared)


def test_chain_dedup_splits_chains(spark):
    """Two passages of 61 words, in the same order in both documents, lie 100 to 500 different words apart."""
    rng = np.random.default_rng(5)
    rows, want = [], set()
    for n, gap in enumerate((100, 200, 350, 500)):
        one, two = prose(rng, 61), prose(rng, 61)
        for d in (2 * n, 2 * n + 1):
            rows.append((d, " ".join(prose(rng, 70) + one + prose(rng, gap) + two + prose(rng, 70))))
            want |= {(d, d ^ 1, 70, 131, 1.0), (d, d ^ 1, 131 + gap, 192 + gap, 1.0)}
    found = chain_dedup.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["partner_id"], r["start"], r["end"], r["identity"]) for r in found} == want


def test_chain_parts_against_brute_force():
    """_parts() finds a range wherever there is one, and only ranges that are finds; halving traces as well as one table."""
    rng = np.random.default_rng(6)
    for _ in range(60):
        x = rng.integers(0, 10**6, 150)
        y = np.where(rng.random(150) < rng.choice([0.1, 0.25, 0.5], 150 // 30).repeat(30), rng.integers(0, 10**6, 150), x)
        y = np.delete(y, rng.integers(0, 150, 3))
        i, j = chain_dedup._pairs(x, y)
        assert (x[i] == y[j]).all() and (np.diff(i) > 0).all() and (np.diff(j) > 0).all()
        assert len(i) == chain_dedup._lengths(x, y)[-1][-1]
        cost = np.r_[0, np.cumsum(np.maximum(np.diff(i), np.diff(j)))]
        some = any(min(i[b] - i[a], j[b] - j[a]) + 1 >= 50 and b - a + 1 >= 0.8 * (cost[b] - cost[a] + 1) - 1e-9 for a in range(len(i)) for b in range(a, len(i)))
        found = chain_dedup._parts(i, j)
        assert bool(found) == some
        assert all(min(p1 - p0, q1 - q0) >= 50 and n >= 0.8 * max(p1 - p0, q1 - q0) for p0, p1, q0, q1, n in found)
    x, y = rng.integers(0, 4, 70), rng.integers(0, 4, 90)
    whole = len(chain_dedup._traced(x, y))
    try:
        cells, chain_dedup.TRACE_CELLS = chain_dedup.TRACE_CELLS, 50
        assert len(chain_dedup._traced(x, y)) == whole
    finally:
        chain_dedup.TRACE_CELLS = cells


def test_token_files(spark, docs, rows, empty, tmp_path):
    t = Tokenizer.from_file(public_tokenizers.path(token_parquet.VOCABULARY))
    t.encode_special_tokens = True
    path = str(tmp_path / "tokens")
    token_parquet.write(docs, path, partitions=4)
    found = token_parquet.index(spark, path).collect()
    ids = {(i, x): np.array([*t.encode(x, add_special_tokens=False).ids, 1], "<u4") for i, x in rows}
    want = Counter((i, len(ids[i, x]), zlib.crc32(ids[i, x].tobytes())) for i, x in rows)
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found) == want
    at = 0
    for r in sorted(found, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(found, key=lambda r: r["start"])]
    assert order[1:] == sorted(order[1:]) and order[0] is None
    assert token_parquet.encode_to_files(empty).count() == 0


def test_words_are_encoded_as_by_the_library():
    path = public_tokenizers.path(token_parquet.VOCABULARY)
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    rng = np.random.default_rng(5)
    plain, odd = "abcXYZ!#$%&'*+,./:;<=>?@[]^_`{|}~-09é\u00dc \t\n\x00\x0b\x1f\x85\xa0", "Hh\u0331\u0301\u1e96\u0130\u1e30\u212a\u3000\u6f22"
    texts = ["".join(rng.choice(list(letters), 40)) for letters in (plain, plain + odd) for _ in range(1500)]
    texts += ["<|startoftext|> <|endoftext|> a<|endoftext|>.", "H\u0331 h\u0331 It's IT'S WE'LL abc.,&&&DEF", ""]
    bpe = token_parquet.WordBpe(path)
    assert bpe.splits
    want = [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    assert bpe.encode(texts) == want and bpe.encode(texts[::-1]) == want[::-1]


def test_token_files_are_read_in_part(spark, tmp_path):
    """A range of documents reads the pages that hold it, and a range of tokens gives the tokens in their places."""
    t = Tokenizer.from_file(public_tokenizers.path(token_parquet.VOCABULARY))
    t.encode_special_tokens = True
    texts = {i: " ".join(f"w{i * j % 997}" for j in range(i % 50)) for i in range(20_000)}
    path = str(tmp_path / "tokens")
    token_parquet.write(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), path, partitions=1)
    ids = {i: [*t.encode(x, add_special_tokens=False).ids, 1] for i, x in list(texts.items())[9000:9100]}
    part = token_parquet.read_documents(spark, path, 9000, 9099)
    assert {r["doc_id"]: r["ids"] for r in part.collect()} == ids
    scan = spark.read.parquet(path).where("doc_id between 9000 and 9099")
    assert scan.count() == 100
    rows = part._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().apply("numOutputRows").value()
    assert 100 <= rows <= 3000
    start = {r["doc_id"]: r["start"] for r in token_parquet.index(spark, path).where("doc_id between 9000 and 9099").collect()}
    low, high = start[9003] + 2, start[9090] + 1
    found = token_parquet.read_tokens(spark, path, low, high).orderBy("start").collect()
    line = [x for i in range(9000, 9100) for x in ids[i]]
    assert [x for r in found for x in r["ids"]] == line[low - start[9000] : high - start[9000]]
    assert all(r["start"] == max(start[r["doc_id"]], low) for r in found)
    assert token_parquet.read_tokens(spark, path, 10**9, 10**9 + 5).count() == 0


def test_token_files_layout(spark, docs, tmp_path):
    import pyarrow.parquet as pq

    path = str(tmp_path / "tokens")
    token_parquet.write(docs, path, partitions=1)
    file = next((tmp_path / "tokens").glob("*.parquet"))
    column = pq.ParquetFile(file).metadata.row_group(0)
    ids = next(column.column(k) for k in range(column.num_columns) if column.column(k).path_in_schema.startswith("ids"))
    assert any("DICTIONARY" in e or "DELTA" in e for e in ids.encodings)
    assert ids.has_column_index and ids.has_offset_index
    assert "ids" not in token_parquet.read(spark, path, ids=False).columns
