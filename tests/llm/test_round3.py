"""Ranked search, periodic runs and byte-pair encoding against plain versions, and their defined cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from tests.llm.test_operators import keyed, table, varied
from textsieve.llm import bpe, impact, queries, repeats

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL_AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_rank(docs, items, k=10):
    split = lambda t: TERM.findall((t or "").translate(SMALL_AZ))
    found = [(d, Counter(split(t))) for d, t in docs]
    found = [(d, c) for d, c in found if c]
    n, total = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in found:
            m = 25 + 75 * sum(c.values()) * n // total
            s = sum(r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, r in Counter(split(text)).items() if t in c)
            scores.append((-s, d is None, d or 0, d))
        out += [(item, i + 1, x[3], -x[0]) for i, x in enumerate(sorted(x for x in scores if x[0] < 0)[:k])]
    return out


def test_ranked_search(spark):
    docs = [*varied(3), *((2000 + i, "same words in many copies É1x") for i in range(40)), (5000, "w1 " * 30000 + "w2"), (5001, "... \x7f --")]
    items = [(i, t) for i, (_, t) in enumerate(varied(8, n=20))] + [(50, "w1 w1 W2 w2 w2 copies"), (51, None), (52, "unseen"), (53, "same, MANY copies"), (53, "same"), (None, "w3-w4")]
    asked = spark.createDataFrame([(*r, "x", "y") for r in items], "item_id long, text string, terms string, row string")
    want = plain_rank(docs, items)
    got = [tuple(r) for r in impact.rank(table(spark, docs), asked).select("item_id", "rank", "doc_id", "score").collect()]
    assert keyed(got) == keyed(want)
    # in blocks of queries, of several blocks of documents, and from an index of all terms as there are more than max_terms
    work = impact.Workspace(spark, "t")
    q = work.write(impact.item_terms(asked), "queries")
    every = impact.build_index(table(spark, docs).repartition(3), q.select("term"), max_terms=4, work=work)
    assert every.blocks.count() == 3 and every.df.count() > q.select("term").distinct().count()
    assert keyed(tuple(r) for r in impact.search(every, q, 10, query_terms=30, work=work).select("item_id", "rank", "doc_id", "score").collect()) == keyed(want)
    assert impact.rank(table(spark, []), asked).count() == 0
    assert impact.rank(table(spark, docs), asked.limit(0)).count() == 0


def test_index_of_all_terms_answers_later_queries(spark):
    docs = varied(4)
    work = impact.Workspace(spark, "t")
    index = impact.build_index(table(spark, docs), work=work)
    df = {r["term"]: r["df"] for r in index.df.collect()}
    assert df == Counter(t for _, x in docs for t in set(TERM.findall((x or "").translate(SMALL_AZ))))
    for k, seed in enumerate((5, 6)):
        items = [(i, t) for i, (_, t) in enumerate(varied(seed, n=12))]
        q = work.write(impact.item_terms(spark.createDataFrame(items, "item_id long, text string")), f"q{k}")
        got = impact.search(index, q, 3, work=work.again()).select("item_id", "rank", "doc_id", "score").collect()
        assert keyed(tuple(r) for r in got) == keyed(plain_rank(docs, items, 3))


def test_bitmap_arithmetic():
    rng = random.Random(2)
    for _ in range(200):
        n, k = rng.randint(1, 70), rng.randint(1, 12)
        bits = lambda xs: [sum((x >> s & 1) << p for p, x in enumerate(xs)) for s in range(20)]
        a, b, w = [rng.choice((0, 1, rng.randrange(1 << 20))) for _ in range(n)], [rng.choice((0, 3, rng.randrange(1 << 20))) for _ in range(n)], rng.randint(1, 30000)
        total = impact.times(bits(a), w)
        shift = rng.randint(0, 5)
        impact.add(total, bits(b), shift)
        want = sorted(((p, w * x + (y << shift)) for p, (x, y) in enumerate(zip(a, b, strict=True)) if w * x + y), key=lambda t: (-t[1], t[0]))
        assert impact.top(total, k) == want[:k]


def plain_runs(w, least=6, times=4):
    """For every period, the stretches that have it; of equal stretches the smallest period."""
    out = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, times * q) and j > i:
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def test_runs_of_random_words():
    rng = random.Random(11)
    for k in range(1500):
        n, size = rng.randint(0, rng.choice((12, 40, 90))), rng.choice((1, 2, 2, 3, 5))
        w = [rng.choice("abcde"[:size]) for _ in range(n)]
        for _ in range(rng.randint(0, 2)):
            block = [rng.choice("abcde"[:size]) for _ in range(rng.randint(1, 6))]
            at = rng.randint(0, len(w))
            w[at:at] = block * rng.randint(2, 7) + block[: rng.randint(0, len(block))]
        for least, times in ((6, 4), (1, 2), (5, 3)):
            assert repeats.text_runs(w, least, times) == plain_runs(w, least, times), (k, w)


def test_runs_of_long_repeats():
    assert repeats.text_runs(["a"] * 60000) == [(0, 60000, 1)]
    assert repeats.text_runs(["a", "b"] * 30000) == [(0, 60000, 2)]
    block = [str(i) for i in range(7001)]
    assert repeats.text_runs(["x", *block * 4, "y"]) == [(1, 4 * 7001, 7001)] and repeats.text_runs(block * 3) == []
    nested = (["p"] * 6 + ["q"]) * 5000
    assert repeats.text_runs(nested) == sorted([(0, 35000, 7), *((7 * i, 6, 1) for i in range(5000))], key=lambda r: (r[0], r[2]))


def test_hashes_alone_prove_nothing(monkeypatch):
    """With hashes that all agree, the words themselves still decide."""
    monkeypatch.setattr(repeats, "BASE", 0)
    rng = random.Random(4)
    for _ in range(200):
        w = [rng.choice("ab") for _ in range(rng.randint(0, 40))]
        x = repeats.Extensions([ord(c) for c in w])
        for i in range(len(w)):
            for j in range(i + 1, len(w)):
                n = x.right(i, j)
                assert w[i : i + n] == w[j : j + n]


def test_find_runs(spark, small):
    rows = [*varied(2), (70, "a " * 9 + "b c"), (71, "x\x0by y " + "1 2 3 " * 5), (72, " ya" * 3), (73, "Ä Ä Ä Ä Ä Ä a"), (74, "long " + "u v w " * 20000)]
    for planted in (False, True):
        got = repeats.find_runs(table(spark, rows), planted=planted)
        want = []
        for d, t in rows:
            w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
            h = zlib.crc32(b"" if d is None else str(d).encode())
            if planted and h % 10 == 0 and w:
                a = h // 10 % len(w)
                p = 1 + (len(w) - a) // (3 + h // 10 % 8)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
            runs = plain_runs(w) if len(w) < 1000 else [(1, 60000, 3)] if d == 74 and not planted else repeats.text_runs(w)
            gone = {i for s, n, q in runs for i in range(s + q, s + n)}
            want.append((d, len(w), runs, " ".join(x for i, x in enumerate(w) if i not in gone)))
        assert keyed((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got.collect()) == keyed(want)
        by_id = {r["doc_id"]: r for r in repeats.digest(got).collect() if r["doc_id"] in (70, 900)}
        if not planted:
            assert by_id[70][1:6] == (1, 0, 9, 1, 9000) and by_id[70]["collapsed_sha256"] == hashlib.sha256(b"a b c").hexdigest() and by_id[70]["runs_sha256"] == hashlib.sha256(b"0,9,1\n").hexdigest()
        empty = hashlib.sha256(b"").hexdigest()
        assert by_id[900][1:] == (0, None, None, None, None, empty, empty)
    assert repeats.digest(repeats.find_runs(table(spark, []))).count() == 0
    assert queries.op12_runs(spark, small).where("n_runs > 0 and period > 6").count() > 0
    with pytest.raises(ValueError):
        repeats.find_runs(table(spark, rows), times=1)


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.DEFAULT_VOCAB)


def test_encoding_equals_the_library(spark, small):
    rng = random.Random(6)
    letters = "aAbeinthsroÉé'1 日ñ-Σσ\n\t\x85​"
    rows = [(i, t) for i, t in enumerate([
        None, "", " \n", "<|endoftext|>a<|startoftext|> ΑΣ ΣΑΣ İstanbul ͸x \U0003fc3b é don't I'LL 'S a　b \x1c d", "<|ENDOFTEXT|> </w> a</w>", "a" * 3000 + "\n" + "-" * 3000 + "é" * 3000, "so " * 500000,
        *("".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(500)),
        *("".join(chr(rng.choice((rng.randint(32, 0x2FF), rng.randint(0x300, 0xD7FF), rng.randint(0x10000, 0x10FFFF)))) for _ in range(30)) for _ in range(200)),
    ])] + [(None, "A null id"), (3, "A repeated id"), (3, "A repeated id")]
    tokenizer = library()
    encoded = bpe.encode(table(spark, rows))
    want = []
    for d, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        want.append((d, ids, tokenizer.decode(ids, skip_special_tokens=False)))
    decoded = bpe.decode(encoded)
    assert keyed((r["doc_id"], r["ids"], r["decoded"]) for r in decoded.collect()) == keyed(want)
    digests = {r["doc_id"]: tuple(r)[1:] for r in bpe.digest(decoded).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert digests[3] in {(len(i), sha(" ".join(map(str, i))), sha(s)) for d, i, s in want if d == 3}
    assert digests[0] == (0, sha(""), sha(""))
    assert bpe.digest(bpe.decode(bpe.encode(table(spark, [])))).count() == 0
    whole = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    ids = {r["doc_id"]: tokenizer.encode(r["text"] or "", add_special_tokens=False).ids for r in whole}
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in queries.op13_bpe(spark, small).collect()} == {d: (len(i), sha(" ".join(map(str, i)))) for d, i in ids.items()}


def test_every_token_of_the_vocabulary_decodes(spark):
    tokenizer = library()
    rows = [(i, list(range(i, 49408, 97))) for i in range(97)] + [(200, None), (201, []), (202, [49407, 1, -1, 10**6, None, 2])]
    got = {r["doc_id"]: r["decoded"] for r in bpe.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>")).collect()}
    assert got == {d: tokenizer.decode([x for x in ids or [] if x is not None and 0 <= x < 49408], skip_special_tokens=False) for d, ids in rows}


def test_merges_must_follow_from_earlier_ones():
    byte = bpe.byte_characters()
    base = [c + s for s in ("", "</w>") for c in byte]
    spec = lambda merges: {"added_tokens": [], "model": {"vocab": {t: i for i, t in enumerate([*base, *dict.fromkeys("".join(m) for m in merges)])}, "merges": merges, "end_of_word_suffix": "</w>"}}
    good = bpe.Bpe(spec([["a", "b"], ["b", "c"], ["ab", "c</w>"], ["a", "a"], ["aa", "aa"]]))
    name = {v: k for k, v in spec([["a", "b"], ["b", "c"], ["ab", "c</w>"], ["a", "a"], ["aa", "aa"]])["model"]["vocab"].items()}
    got = {w: [name[i] for i in ids] for w, ids in good.encode({"abc", "bca", "aaaaa", "aaaaaa", "abcd", "abcc"})}
    assert got == {"abc": ["abc</w>"], "bca": ["bc", "a</w>"], "aaaaa": ["aaaa", "a</w>"], "aaaaaa": ["aaaa", "a", "a</w>"], "abcd": ["ab", "c", "d</w>"], "abcc": ["ab", "c", "c</w>"]}
    for merges in ([["ab", "c"], ["a", "b"]], [["a</w>", "b"]], [["a", "b"], ["a", "b"]]):
        with pytest.raises(ValueError):
            bpe.Bpe(spec(merges))
    with pytest.raises(ValueError):
        bpe.Bpe(spec([]), max_vocab=100)
