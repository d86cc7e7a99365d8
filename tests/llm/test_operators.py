"""The ten text operators against brute force, with awkward rows: nulls, empty
and long texts, repeated rows, clashing column names, empty tables."""

import collections
import hashlib
import html as html_module
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from privtab.llm import (bpe, decontaminate, eliasfano, fingerprint, html_text, langid, licenses, lm, neardup, queries,
                         substrings, urls)

SF = "/root/testdata/sf0.001"
VOCABULARY = queries.vocabulary()


def some_texts():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 120))) for _ in range(40)]
    for i in range(0, 20, 2):  # near copies of some
        words = texts[i].split()
        words[len(words) // 2] = "EDITED"
        texts.append("\n".join(words))
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    texts += [passage + " " + t for t in texts[30:36]]
    texts += ["", None, " \t\n", "One", "a b c", "word " * 3000, texts[0], texts[0], "ÀB c　d", texts[3].upper()]
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def rows():
    return some_texts()


@pytest.fixture(scope="module")
def docs(spark, rows):
    """Extra columns carry names that the operators use inside."""
    extra = [(i, t, "x", 1, "carry", 7) for i, t in rows]
    return spark.createDataFrame(extra, "doc_id long, text string, sig string, node int, carry string, n long").repartition(3)


def words_of(text, lower=False):
    raw = (text or "").encode()
    return re.findall(rb"[^\x20\x09-\x0D]+", raw.lower() if lower else raw)


def shingles(text):
    w = words_of(text, True)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_classes(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_near_duplicates(docs, rows):
    want = brute_classes(rows)
    got = {r.doc_id: r for r in neardup.near_duplicates(docs).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_near_duplicates_family_without_a_hub(spark):
    """Copies of a text that is not there: links run between copies only."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(rng.choice((2, 4, 6, 8))):
            words[rng.randrange(200)] = f"x{rng.random()}"
        rows.append((i, " ".join(words)))
    want = brute_classes(rows)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_blocks_compare_exactly():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 500, rng.integers(1, 200)).astype(np.uint64)) for _ in range(30)]
    both = neardup._overlaps(sets[:20], sets[10:], chunk=64)
    assert all(both[i, j] == len(np.intersect1d(a, b)) for i, a in enumerate(sets[:20]) for j, b in enumerate(sets[10:]))


def test_null_ids(spark):
    rows = [(None, "a b c d e f"), (None, None), (4, "a b c d e f"), (2, "a b c d e f")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in neardup.near_duplicates(d).collect()) == [
        (-1, -1, True), (-1, -1, True), (2, 2, True), (4, 2, False)]
    assert substrings.remove_repeats(d).count() == 4
    assert lm.score_texts(d, F.col("doc_id") == 2).count() == 4
    assert fingerprint.fingerprints(d).count() == 4


def test_remove_repeats(docs, rows):
    first = {}
    split = {i: words_of(t) for i, t in rows}
    for i in sorted(split):
        for a in range(len(split[i]) - 12):
            first.setdefault(tuple(split[i][a:a + 13]), i)
    got = {r.doc_id: r for r in substrings.remove_repeats(docs, carry=("carry", "n")).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        w = split[i]
        cover = [False] * len(w)
        for a in range(len(w) - 12):
            if first[tuple(w[a:a + 13])] < i:
                cover[a:a + 13] = [True] * 13
        kept = b" ".join(x for x, c in zip(w, cover) if not c)
        r = got[i]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(w), sum(cover), hashlib.sha256(kept).hexdigest())
        assert r.kept_text == (kept.decode() if any(cover) else text or "")
        assert [k for a, b in zip(r.begins, r.ends) for k in range(a, b)] == [k for k, c in enumerate(cover) if c]
        assert tuple(r.carry) == ("carry", 7)


def test_one_id_for_two_texts(spark):
    """An id that stands for two texts is judged for each."""
    passage = " ".join(f"p{i}" for i in range(20))
    d = spark.createDataFrame([(1, passage), (2, "other words " + passage), (2, "nothing shared")],
                              "doc_id long, text string")
    assert sorted(r.n_removed for r in substrings.remove_repeats(d).collect()) == [0, 0, 20]


def test_decontamination(spark, docs, rows):
    items = [(0, rows[30][1]), (1, "a b c"), (2, None), (3, ""), (10, rows[30][1]), (11, rows[7][1].upper() + "!"), (None, "x")]
    bench = spark.createDataFrame(items, "item_id long, text string")

    def cut(t):
        low = (t or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))
        return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    windows = collections.defaultdict(set)
    for i, t in items:
        w = cut(t)
        n = min(10, len(w))
        for a in range(len(w) - n + 1):
            if n:
                windows[tuple(w[a:a + n])].add(i)
    got = {r.doc_id: r for r in decontaminate.contamination(docs, bench, carry=("sig",)).collect()}
    for i, t in rows:
        w = cut(t)
        cover, hits = [False] * len(w), set()
        for n in {len(k) for k in windows}:
            for a in range(len(w) - n + 1):
                if tuple(w[a:a + n]) in windows:
                    hits |= windows[tuple(w[a:a + n])]
                    cover[a:a + n] = [True] * n
        names = ",".join(sorted(str(h) for h in hits if h is not None))
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), sum(cover), len(hits), any(cover))
        assert r.items_sha256 == hashlib.sha256(names.encode()).hexdigest()


def test_documents_and_items_without_ids(spark):
    """Judged as others are; a short item changes nothing for long ones."""
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(5, f"x {text} y"), (None, f"x {text} y"), (None, "clean words only here"), (None, None), (6, "zebra"), (6, "none")]
    items = [(None, text), (3, text + " thirteen"), (3, "zebra"), (4, None), (None, None), (8, "a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.n_words): (r.n_hit, r.n_items, r.items, r.contaminated)
           for r in decontaminate.contamination(docs, bench).collect()}
    assert got[5, 14] == got[None, 14] == (12, 2, ["3"], True)
    assert got[None, 4] == (0, 0, [], False) and got[None, 0] == (0, 0, [], False)
    assert len(got) == 5 and got[6, 1] in ((1, 1, ["3"], True), (0, 0, [], False))
    spans = [s for s in (1, 3, 10)]
    hashes = decontaminate.C.word_hashes(decontaminate.C.words_alnum(text.encode()))
    alone = decontaminate.winnow(np.array([len(hashes)]), hashes, 6, 5)[1]
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([text])], names=["doc", "sig", "text"])
    def made(spans):
        return [b.column("print").to_pylist() for b in decontaminate._fingerprints(10, 6, spans, False)(iter([batch]))]
    assert made(spans)[-1] == made([10])[0] and len(made([10])[0]) == len(alone)


def test_a_full_bucket_fits_a_task():
    """A bucket of BUCKET_BYTES of text, all of its windows different."""
    from privtab.llm import common
    rng = np.random.default_rng(1)
    words = common.BUCKET_BYTES // 6
    rows = []
    for part in range(4):
        n = words // 4
        ids = np.sort(rng.integers(0, 1 << 40, n // 300 + 1))[np.arange(n) // 300]
        rows.append((0, False, *substrings._pack(ids, np.zeros(n, np.uint16), (np.arange(n) % 300).astype(np.int64)),
                     common.squeeze(rng.integers(0, 1 << 63, n).astype(np.uint64))))
    table = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), substrings._REQUEST)], schema=substrings._REQUEST)
    tracemalloc.start()
    out = substrings._answers(256)(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.num_rows == 0 and peak < 400 << 20


def test_a_sample_of_any_language():
    """The share that is learned from does not vanish however many texts there are."""
    for n in (1, 10**6, 1_048_576_001, 10**13):
        limit = (langid.SAMPLE << 52) // n
        assert 0 < limit < 1 << 63 and (n < langid.SAMPLE or limit * n // (1 << 52) in (langid.SAMPLE, langid.SAMPLE - 1))


def test_bpe_equals_the_library(spark, rows):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(VOCABULARY)
    rng = random.Random(3)
    letters = list("aeth  \n\t'sdv.,!?09éñ漢😀　\xa0\x1c\x85​\r") + ["<|endoftext|>", "'re", " the", "  "]
    texts = [t for _, t in rows] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(500)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in bpe.encode_texts(d, VOCABULARY).collect():
        want = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == want and r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(np.asarray(want, "<u4").tobytes()).hexdigest()
        assert r.decoded == library.decode(want, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()


def test_fingerprints(docs, rows):
    got = {r.doc_id: r for r in fingerprint.fingerprints(docs).collect()}
    order = sorted(got, reverse=True)
    text = {i: t or "" for i, t in rows}
    marks = collections.defaultdict(set)
    for k, i in enumerate(order):
        t, after = text[i], text[order[(k + 1) % len(order)]]
        half = len(t) // 2
        edited = t[:len(t) - half] + after[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.near_edited == 1) >= (t == edited) and (r.fingerprint == r.edited_fingerprint) == (t == edited)
        same = 0
        while same < min(len(t), len(edited)) and t[same] == edited[same]:
            same += 1
        assert r.common_edited == same
        marks[r.fingerprint].add(t)
    assert all(len(texts) == 1 for texts in marks.values())


def test_span_equality_and_extensions():
    rng = random.Random(2)
    a, b = ("".join(rng.choice("ab") for _ in range(200)) for _ in range(2))
    x, y = (fingerprint.Prefixes(fingerprint.code_points(t)) for t in (a, b))
    for _ in range(300):
        i, j, n = rng.randrange(180), rng.randrange(180), rng.randrange(20)
        assert x.same(i, y, j, n) == (a[i:i + n] == b[j:j + n])
        want = 0
        while i + want < 200 and j + want < 200 and a[i + want] == b[j + want]:
            want += 1
        assert x.common(i, y, j) == want


def test_language_model(docs, rows):
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    got = {r.doc_id: r for r in lm.score_texts(docs, queries.remainder("doc_id", 7) == 2).collect()}
    tokens = {i: [*words_of(t, True), None] for i, t in rows}
    one, two, three, texts = collections.Counter(), collections.Counter(), collections.Counter(), 0
    for i, w in tokens.items():
        if not held(i):
            one.update(w)
            two.update(zip(["start", *w], w))
            three.update(zip(["start", "start", *w], ["start", *w], w))
            texts += 1
    total, distinct = sum(one.values()), len(one)
    for i, w in tokens.items():
        r = got[i]
        base = sum(math.log10((one[x] + 1) / (total + distinct + 1)) for x in w)
        score = 0
        for v, u, x in zip(["start", "start", *w], ["start", *w], w):
            least = lm.MERGE * (two[u, x] + lm.PRIOR * (one[x] + 1) / (total + distinct + 1))
            seen, near = (texts, texts) if u == "start" else (two[v, u], one[u])
            score += math.log10((three[v, u, x] + least) / (seen + lm.MERGE * (near + lm.PRIOR)))
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(w), sum(one[x] > 0 for x in w), total)
        assert abs(r.base_score - base) < 1e-6 and abs(r.score - score) <= 0.0015 * len(w) + 1e-3


def test_elias_fano():
    rng = np.random.default_rng(0)
    for top in (5, 1 << 40):
        for n in (0, 1, 1000):
            values = np.unique(rng.integers(0, top, n, dtype=np.uint64))
            e = eliasfano.EliasFano.of(values, top)
            ask = rng.integers(0, top, 300, dtype=np.uint64)
            assert (e.access(np.arange(len(values))) == values).all()
            assert (e.find(ask) == np.where(np.isin(ask, values), np.searchsorted(values, ask), -1)).all()


def test_trie_levels(tmp_path):
    rng = np.random.default_rng(3)
    words = np.unique(rng.integers(0, 1 << 63, 50, dtype=np.uint64))
    grams = sorted({(int(a), int(b), int(c)) for a, b, c in zip(
        rng.integers(0, 50, 4000), rng.integers(0, 40, 4000) ** 2, rng.integers(0, 1 << 28, 4000) % 9)
        if a % 7})  # some words have no context
    pairs = sorted({g[:2] for g in grams})
    of_pair = np.asarray([pairs.index(g[:2]) for g in grams])
    column = lambda rows, k, t: np.asarray([r[k] for r in rows], t)
    numbers = [np.arange(n) for n in (50, 50, len(pairs), len(pairs), len(grams))]
    trie = eliasfano.Trie.build(words, np.arange(50), column(pairs, 0, np.int64), column(pairs, 1, np.uint64),
                                of_pair, column(grams, 2, np.uint64), *numbers)
    with open(tmp_path / "trie", "wb+") as file:
        for t in (trie, trie.mapped(), trie.mapped(file.fileno())):
            place = {p: i for i, p in enumerate(pairs)}
            asked = [(a, b, c) for a in range(50) for b in range(0, 41 ** 2, 9) for c in range(10)]
            one = t.words.find(words[column(asked, 0, np.int64)])
            two = t.near.find(one, column(asked, 1, np.uint64))
            three = t.far.find(two, column(asked, 2, np.uint64))
            own = {g: i for i, g in enumerate(grams)}
            assert two.tolist() == [place.get(g[:2], -1) for g in asked]
            assert three.tolist() == [own.get(g, -1) for g in asked] and max(three) > 0
            assert t.prob[three[three >= 0]].tolist() == three[three >= 0].tolist()


def test_blocks_that_lack_answers_are_refused():
    roster = pa.Table.from_arrays([pa.array([v], t) for v, (_, t) in zip(
        (1, 0, lm.C.squeeze(np.asarray([5])), lm.C.squeeze(np.asarray([2, 3])), lm.C.squeeze(np.zeros(1, np.uint8)),
         lm.C.squeeze(np.zeros(1, np.uint8))), lm._ANSWER_ARROW)], names=[n for n, _ in lm._ANSWER_ARROW])
    with pytest.raises(RuntimeError, match="rerun"):
        lm._finish(10, 3, 1, lm.PRIOR, lm.MERGE)(roster)


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    extra = spark.createDataFrame([(10**6, None, "en"), (10**6 + 1, "", "en"), (10**6 + 2, "123 ... 456", None)],
                                  "doc_id long, text string, lang string")
    both = docs.select("doc_id", "text", "lang").unionByName(extra)
    out = langid.identify(both, queries.remainder("doc_id", 4) != 2, carry=("lang",)).collect()
    assert all((r.lang_pred, r.score, r.rejected) == ("und", 0.0, True) for r in out if r.doc_id >= 10**6)
    known = [r for r in out if r.doc_id < 10**6]
    held = [r for r in known if not r.trained]
    assert sum(r.lang_pred == r.carry.lang for r in held) / len(held) > 0.97
    assert not any(r.rejected for r in known) and all(0 <= r.score <= 1 for r in known)


URLS = ["http://A.Example.NET/en/1?x=1", "https://www.example.net/de/2", "http://example.net", "http://notexample.net/en/",
        "http://m.example.com/de/x#y", "http://example.com/fr/", "http://example.org/fr/9", "http://org/fr/", "x.net/en/",
        None, "", "http://", "ftp://net/?q", "http://h.org/frx", "http://a.b.example.org/fr/z?://k.net/"]


def test_url_rules(spark):
    d = spark.createDataFrame(list(enumerate(URLS * 3)), "page_id long, url string")
    for r in urls.judge(d).collect():
        url = (URLS * 3)[r.page_id]
        _, mark, rest = (url or "").partition("://")
        host = re.match(r"[^/?#]*", rest)[0] if mark else ""
        path = re.match(r"[^?#]*", rest[len(host):])[0] if mark else ""
        host = host.lower()
        fits = [x for x in urls.RULES for s, p in [x.split("/", 1)]
                if (host == s or host.endswith("." + s)) and path.startswith("/" + p)]
        rule = max(fits, key=len, default=None)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == urls.RULES[rule] if rule else r.verdict in ("allow", "block")


def test_url_model_learns(spark):
    table = [(f"http://casino{i}.example.org/win/{i}", "block") for i in range(60)]
    table += [(f"http://library{i}.example.org/book/{i}", "allow") for i in range(60)]
    labelled = spark.createDataFrame(table, "url string, verdict string")
    d = spark.createDataFrame([(1, "http://casino999.example.org/win/1"), (2, "http://library999.example.org/book/4")],
                              "page_id long, url string")
    assert dict((r.page_id, r.verdict) for r in urls.judge(d, rules={}, labelled=labelled).collect()) == {1: "block", 2: "allow"}


def test_licenses(spark):
    whole = "Copyright (c) 2020 Someone\n" + licenses._MIT.replace("sublicense", "sub-licence").upper()
    rows = [(1, whole), (2, "Text.\nReleased  under the MIT Licence\nmore"), (3, None), (4, ""), (5, "Copyright 2020 X"),
            (6, "licensed under the Apache License, Version 2.0."), (6, "licensed under the Apache License, Version 2.0.")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.whole, r.n_notices, r.licenses) for r in licenses.scan(d).collect())
    assert [(a, b, d_) for a, b, _, d_ in got] == [
        (1, "MIT", "MIT"), (2, None, "MIT"), (3, None, ""), (4, None, ""), (5, None, ""),
        (6, "Apache-2.0", "Apache-2.0"), (6, "Apache-2.0", "Apache-2.0")]


def wrapped(text, width, lead=""):
    lines, line = [], ""
    for word in text.split():
        if line and len(line) + len(word) >= width:
            lines.append(line)
            line = ""
        line = f"{line} {word}".strip()
    return "\n".join(lead + x for x in [*lines, line])


def canonical_lines(text):
    """The lines of ``licenses.canonical``, by plain Python."""
    out = re.sub(licenses.COPYRIGHT, "\n", text.lower())
    lines = [re.sub(licenses.BETWEEN_WORDS, " ", x).strip(" ") for x in out.split("\n")]
    for said, meant in licenses.SPELLINGS:
        lines = [x.replace(said, meant) for x in lines]
    return [re.sub(r"(^| )v([0-9])", r"\1v \2", x) for x in lines if x]


def test_license_runs_of_lines_against_brute_force(spark):
    bsd = licenses.KNOWN[-1][1]
    texts = ["/*\n" + wrapped(licenses._MIT, 60, " * ") + "\n */\nint main() {}", "# Tool\n\nSome words.\n\n## License\n\n" +
             wrapped(licenses._MIT, 72) + "\n\n## More\nwords", wrapped(bsd, 40, "// "), wrapped(licenses._APACHE_NOTICE, 30, "# "),
             "see " + licenses._MIT, licenses._MIT + " and more", licenses._MIT.replace("free of charge", "for money"),
             "\n".join(licenses._ISC.split()), wrapped(licenses._UNLICENSE, 70) + "\n" + wrapped(licenses._ZLIB, 70), None, "", " \n\n",
             "Licensed under\nthe MIT\n\nLicense.", "Copyright (c) 2020 X\n" + wrapped(licenses._MIT, 50), "Licensed under CC-BY-4.0",
             "This work is licensed under the GNU General Public Licence, v3", "license\n" * 2000 + "Licensed under the MIT License."]
    known = {}
    for name, text in licenses.KNOWN:
        known.setdefault(" ".join(canonical_lines(text)), set()).add(name)

    def brute(text):
        lines = canonical_lines(text or "")
        found, places = set(), set()
        for i in range(len(lines)):
            run = ""
            for j in range(i, min(len(lines), i + 300)):
                run = f"{run} {lines[j]}".strip()
                if run in known:
                    found |= known[run]
                    places.add(i)
        return ",".join(sorted(known.get(" ".join(lines), ()))) or None, len(places), ",".join(sorted(found))

    rows = [(i, t, "x", i) for i, t in enumerate(texts)] + [(None, texts[0], None, 1), (0, texts[0], "x", 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, license string, row int")
    got = [(r.doc_id, r.whole, r.n_notices, r.licenses) for r in licenses.scan(d).collect()]
    assert sorted(got, key=repr) == sorted([(i, *brute(t)) for i, t, *_ in rows], key=repr)
    assert [g[3] for g in sorted(got, key=repr) if g[0] in (1, 2)] == ["MIT", "BSD-3-Clause"]


def test_licenses_found_by_digest_only(spark):
    """A long text given by its digest alone: wrapped anew and inside of other lines."""
    long = " ".join(f"Term {i} of the sub-licence, version {i % 7}." for i in range(900))
    d = spark.createDataFrame([(1, "Intro\n" + wrapped(long, 33, "* ") + "\nend"), (2, wrapped(long, 90) + " tail"), (3, long)],
                              "doc_id long, text string")
    known = spark.createDataFrame([("Long", long), ("Empty", " . "), ("Short", "end")], "license string, text string")
    got = sorted((r.doc_id, r.whole, r.n_notices, r.licenses) for r in licenses.scan(d, known).collect())
    assert got == [(1, None, 2, "Long,Short"), (2, None, 0, ""), (3, "Long", 1, "Long")]
    nothing = known.filter("license = 'Empty'")
    assert [r.licenses for r in licenses.scan(d, nothing).collect()] == ["", "", ""]


def test_license_digests_are_of_canonical_texts(spark):
    table = licenses.known_texts(spark).collect()
    assert len({r.license for r in table}) == 23
    assert all(len(r.form_start.split()) == licenses.FIRST_WORDS and len(r.digest) == 64 for r in table if r.words > 4)


def test_main_text_on_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    for r in html_text.extract_pages(pages).collect():
        article = re.search(r"<article>(.*?)(</article>|$)", html[r.page_id], re.S)[1]
        blocks = re.sub(r"</?b>", "", re.sub(r"<br>", " ", re.sub(r"</?(h1|p)>", "\0", article))).split("\0")
        want = "\n".join(x for x in (" ".join(html_module.unescape(b).split()) for b in blocks) if x)
        assert (r.text, r.n_chars) == (want, len(want))


def test_main_text_without_an_article():
    page = """<html><body><header><h1>Site</h1></header><div class="menu"><a href=x>Menu</a></div><div id=wrap>
        <div class=content><h1>Title here</h1><p>A long paragraph with many words, and so on and on.</p><p>Short.</p>
        <p>Another long paragraph with <a href=x>a link</a> and&nbsp;more &amp; more text.</p></div>
        <div class=sidebar>Side</div><div class="comments"><p>A long comment by a reader, who writes a lot of things.</p></div>
        </div><footer>2020</footer></body></html>"""
    assert html_text.main_text(page) == ("Title here\nA long paragraph with many words, and so on and on.\nShort.\n"
                                         "Another long paragraph with a link and more & more text.")
    assert [html_text.main_text(x) for x in (None, "", "plain", "<p>cut <b", "<script>x</script>")] == ["", "", "plain", "cut", ""]


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string, lang string")
    p = spark.createDataFrame([], "page_id long, url string, html string")
    b = spark.createDataFrame([], "item_id long, text string")
    for out in (neardup.near_duplicates(d), substrings.remove_repeats(d), licenses.scan(d), decontaminate.contamination(d, b),
                bpe.encode_texts(d, VOCABULARY), fingerprint.fingerprints(d),
                langid.identify(d, F.lit(True)), lm.score_texts(d, F.lit(False)), html_text.extract_pages(p), urls.judge(p)):
        assert out.count() == 0


STRANGE = ["Все люди рождаются свободными и равными в своём достоинстве и правах.", "Все", "人人生而自由,在尊严和权利上一律平等。",
           "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα.",
           "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem.",
           "xkcd qwrtz bcdfg hjklm npqrst vwxzq zzkx ptkfgh mnbvc lkjhg fdsqz wrtpl kjhgf dsxcv bnmqw rtzpl"]


def test_language_rejects_what_it_has_not_learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    short = docs.select(F.col("doc_id") + 10**6, F.substring("text", 1, 40).alias("text"), "lang").filter("length(text) = 40")
    strange = spark.createDataFrame([(-1 - i, t * n, None) for n in (1, 20) for i, t in enumerate(STRANGE)],
                                    "doc_id long, text string, lang string")
    both = docs.unionByName(short.toDF("doc_id", "text", "lang")).unionByName(strange)
    trains = (F.col("doc_id").between(0, 10**6 - 1)) & (queries.remainder("doc_id", 4) != 2)
    out = langid.identify(both, trains, carry=("lang",)).collect()
    assert all(r.rejected for r in out if r.doc_id < 0)
    clean = [r for r in out if r.doc_id >= 10**6]
    assert sum(r.rejected for r in clean) < 0.01 * len(clean)


def _notices(n):
    """Distinct short texts, one word of each of its own: not similar, but of one key each."""
    return [f"this notice was sent to m{i} on behalf of the office and needs no reply" for i in range(n)]


def test_blocks_of_short_texts_are_bounded_in_memory():
    n = 4000
    table = pa.Table.from_pydict({"head": [0] * n, "node": list(range(n)), "label": list(range(n)), "block": [0] * n,
                                  "bi": [0] * n, "bj": [0] * n,
                                  "text": [neardup.C.zip_text(t.encode()) for t in _notices(n - 1)] +
                                  [neardup.C.zip_text(_notices(1)[0].encode())]})
    tracemalloc.start()
    links = neardup._block_links(table).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert links == [{"a": 0, "b": n - 1}] and peak < 200 << 20


def test_near_duplicates_in_many_blocks(spark, monkeypatch):
    """Large groups are pruned and dealt by size, and give the same classes."""
    monkeypatch.setattr(neardup, "DOCS", 16)
    monkeypatch.setattr(neardup, "HOT", 20)
    rng = random.Random(3)
    texts = _notices(150)
    for size in (60, 200, 70, 55):
        base = [f"w{i}" for i in range(size)]
        for _ in range(60):
            words = base[:rng.randrange(size // 2, size + 1)] if rng.random() < 0.3 else list(base)
            for _ in range(rng.choice((1, 2, 3, 5))):
                words[rng.randrange(len(words))] = f"x{rng.randrange(4000)}"
            texts.append(" ".join(words))
    rows = list(enumerate(texts))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_classes(rows)


def test_template_texts_do_not_meet(spark):
    rows = [(i, neardup.C.zip_text(t.encode())) for i, t in enumerate(_notices(500))]
    texts = spark.createDataFrame(rows, "node long, text binary")
    group = texts.select(F.lit(0).cast("long").alias("head"), "node", F.col("node").alias("label"),
                         F.lit(10).cast("long").alias("n"))
    assert neardup.alive(group, texts).count() == 0


LONG = ["A long paragraph with many words, and so on and on, until there are enough of them.",
        "Another long paragraph, with as many words as the first one had, or nearly so.",
        "A third one that ends the page, and that is a little longer than the others are here."]


@pytest.mark.parametrize("wrapper", ["site has-sidebar", "no-sidebar", "with-banner", "search-result", "post social"])
def test_main_text_in_a_wrapper_with_a_noise_word(wrapper):
    body = "".join(f"<p>{x}</p>" for x in LONG)
    page = f"""<html><body><div class="site-footer nav"><a href=x>Menu</a> <a href=y>More</a></div><div class="{wrapper}">
        <div class="text">{body}</div><div class="sidebar"><a href=x>Side</a></div></div></body></html>"""
    assert html_text.main_text(page) == "\n".join(LONG)


def test_main_text_keeps_a_small_second_part():
    first = "".join(f"<p>{x}</p>" for x in LONG * 6)
    links = "<p><a href=x>Go</a> <a href=y>on</a></p>" * 6
    page = (f"<html><body><div>{links}</div><div id=wrap><div>{first}</div><div><p>{LONG[0]}</p></div></div>"
            f"<div>{links}</div></body></html>")
    assert html_text.main_text(page) == "\n".join(LONG * 6 + LONG[:1])
