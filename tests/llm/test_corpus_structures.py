"""Collocations, packing and the prefix trie against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from ionolake.llm import collocations, packing, prefix_trie
from tests.llm.test_llm_operators import prose, table

# 11


def brute_collocations(rows, least, top):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    out = collections.defaultdict(list)
    often = {p: c for p, c in f.items() if c >= least}
    for (lang, p), a in often.items():
        if len(p) < 2:
            continue
        score, cut = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        held = any(c >= a and q_lang == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) for (q_lang, q), c in often.items())
        if not held:
            out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:cut]], f[lang, p[cut:]]))
    return {(lang, r + 1, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for lang, xs in out.items() for r, x in enumerate(sorted(xs)[:top])}


def phrase_rows():
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["alpha", "Beta", "GAMMA delta", "delta", "x,", "y.", "é", "\tq", "alpha beta gamma"]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None, "fr"]), "s", 1) for i in range(80)]
    return [*rows, (200, None, "en", "s", 1), (201, "", None, None, None), (202, " .,;!? \n\r", "de", "s", 1), (203, "alpha beta " * 9, "en", "s", 1), (203, "alpha beta " * 9, "en", "s", 1), (None, "É é É" * 30, "en", None, 1), (204, "one two three four five six " * 40, "en", "s", 1)]


@pytest.mark.parametrize("bits", [3, 12, 22])
def test_collocations_by_brute_force_at_any_number_of_buckets(spark, monkeypatch, bits):
    rows = phrase_rows()
    monkeypatch.setattr(collocations, "FLUSH", 20)
    docs = table(spark, rows).repartition(3)
    for least, top in ((5, 2000), (12, 7)):
        got = {tuple(r) for r in collocations.collocations(docs, least=least, top=top, bits=bits).collect()}
        assert got == brute_collocations([(r[2], r[1]) for r in rows], least, top) and got


def test_collocations_of_a_text_in_segments(spark, monkeypatch):
    long = prose(3, 4000).replace("coth", "coth,").replace("anth", "anth\t") + " " + "z" * 5000 + " " + prose(3, 300)
    monkeypatch.setattr(collocations, "SEGMENT", 700)
    got = {tuple(r) for r in collocations.collocations(table(spark, [(1, long, "en", "s", 1)]), least=3, bits=16).collect()}
    assert got == brute_collocations([("en", long)], 3, 2000) and len(got) > 20


def test_collocations_without_rows_and_beyond_64_bits(spark):
    assert collocations.collocations(table(spark, [])).count() == 0
    assert collocations.collocations(table(spark, [(1, None, None, None, None)])).count() == 0
    a, l_, r_, n = 3_000_000_007, 5_000_000_029, 7_000_000_001, 9_999_999_999_999_937
    frequent = spark.createDataFrame([("en", "a b", 2, a), ("en", "a", 1, l_), ("en", "b", 1, r_)], "lang string, phrase string, k int, f long")
    x = collocations.score(frequent, spark.createDataFrame([("en", n)], "lang string, n long")).first()
    assert x["score"] == 1000 * a * n // (l_ * r_) and 1000 * a * n > 2**64


# 12


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
        raw = f.read()
    return raw, Tokenizer.from_buffer(raw)


def test_encoder_gives_the_tokenizers_ids(tokenizer, monkeypatch):
    raw, whole = tokenizer
    monkeypatch.setattr(packing, "SEGMENT", 400)
    monkeypatch.setattr(packing, "CACHE", 300)
    rng = random.Random(2)
    signs = ["a", "Z", "s", "'", "'s", "'ll", ".", ",", "!", " ", "\n", "\t", " ", "é", "é", "J", "̌", "Σ", "1", "²", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "—", "😀", "\x00", "\x85", "\xa0", "ß", "İ", "中", "×", "?'s", "K", "word", "antidisestablishmentarianism"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 40))) for _ in range(3000)] + [prose(1, 900) + " é " + prose(2, 900), "x" * 3000, None, ""]
    got = list(packing.Encoder(raw).documents(pa.array(texts)))
    assert [g.tolist() for g in got] == [[*whole.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]


def check_packing(rows, docs, whole):
    ids = collections.Counter()
    for doc, text in docs:
        x = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        ids[doc, len(x)] += len(x)
    texts = collections.defaultdict(list)
    for doc, text in docs:
        texts[doc].append(np.array([*whole.encode(text or "", add_special_tokens=False).ids, 2], "<u4"))
    got = collections.Counter()
    for r in rows:
        got[r["doc_id"], r["doc_tokens"]] += r["length"]
        assert any(len(x) == r["doc_tokens"] and zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for x in texts[r["doc_id"]])
    assert got == ids
    per = collections.defaultdict(list)
    for r in rows:
        per[r["sequence_id"]].append((r["offset"], r["length"]))
    for x in per.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at and length > 0
            at += length
        assert at <= packing.CAPACITY and at & (at - 1) == 0
    tails = [sum(n for _, n in x) for x in per.values() if sum(n for _, n in x) < packing.CAPACITY]
    assert len(tails) == len(set(tails))
    for doc, xs in texts.items():
        if len(xs) == 1:
            mine = sorted((r["start"], r["length"]) for r in rows if r["doc_id"] == doc)
            assert [s for s, _ in mine] == [sum(n for _, n in mine[:i]) for i in range(len(mine))]


def test_packing_by_brute_force(spark, tokenizer, monkeypatch):
    raw, whole = tokenizer
    rows = [(i, prose(i, 1 + 37 * i % 700), "en", "s", 1) for i in range(150)]
    rows += [(500, None, None, None, None), (501, "", "en", "s", 0), (502, prose(9, 12_000), "en", "s", 1), (503, prose(4, 90), "en", "s", 1), (503, prose(4, 90), "en", "s", 1), (503, prose(5, 90), "en", "s", 1), (None, prose(6, 10), None, None, None)]
    monkeypatch.setattr(packing, "FAN", 2)
    for parts in (1, 7):
        got = packing.pack_documents(table(spark, rows).repartition(parts)).collect()
        check_packing(got, [(r[0], r[1]) for r in rows], whole)
    assert packing.pack_documents(table(spark, [])).count() == 0


def test_packing_balances_cost():
    packer, rng = packing.Packer(0), random.Random(1)
    sizes = [rng.randint(1, 3000) for _ in range(2000)]
    packer.pack([(i, 0, n, np.zeros(n, np.uint32)) for i, n in enumerate(sizes)])
    spent = collections.Counter()
    for _, _, n, _, _, s, _ in packer.placed:
        spent[s] += packing.cost(n)
    assert sum(len(p[3]) for p in packer.rest) < packing.CAPACITY and len(packer.placed) <= len(sizes) + len(spent)
    assert max(spent.values()) < 1.35 * (sum(spent.values()) / len(spent))


# 13


def brute_trie(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            r, x = role or "", text or ""
            own[c].append(((turn is not None, turn or 0), hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).digest()[:16], (r, x)))
    own = {c: [x for *_, x in sorted(v)] for c, v in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = (*own.get(c - c % 20, [])[:h], *own[c][h:])
    members = collections.defaultdict(list)
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    kids, leaves, saved = collections.Counter(p[:-1] for p in members if p), collections.Counter(), collections.Counter()
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    ends = {p: ",".join(map(str, sorted(c for c in m if len(built[c]) == len(p)))) for p, m in members.items()}
    return {(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends[p].encode()).hexdigest()) for p, m in members.items()}


CONV = "conv_id long, turn long, role string, text string, depth int, names string"


def conversation_rows(n=260):
    rng = random.Random(8)
    rows = []
    for c in range(n):
        turns = ["hello  there", "hi\tyou\x0bthere", "", None, "one two three"] if c % 3 == 0 else [rng.choice(["hello  there", "a b", "c", "ä ü ö"]) for _ in range(rng.randint(1, 7))]
        rows += [(c if c % 11 else c + 4000, None if k == 2 and c % 5 == 0 else k, ["user", "assistant", None][k % 3], t, 1, "x") for k, t in enumerate(turns)]
    rows += [(9000, k, "user", f"t{k % 9}", 1, "x") for k in range(300)] + [(9020, k, "user", f"t{k % 9}", 1, "x") for k in range(280)]
    return rows + [(None, 1, "user", "lost", 1, "x"), (77, 1, "user", "again", 1, "x"), (77, 1, "user", "again", 1, "x"), (9001, 0, "user", "only", 1, "x"), (-3, 0, "user", "below zero", 1, "x"), (9003, 1, "user", "long " * 30_000, 1, "x")]


@pytest.mark.parametrize("fan,listed,parts", [(64, 4096, 4), (2, 3, 23)])
def test_trie_by_brute_force(spark, monkeypatch, fan, listed, parts):
    monkeypatch.setattr(prefix_trie, "FAN", fan)
    monkeypatch.setattr(prefix_trie, "LISTED", listed)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = conversation_rows()
        got = [tuple(r) for r in prefix_trie.conversation_trie(spark.createDataFrame(rows, CONV)).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    want = brute_trie([r[:4] for r in rows])
    assert set(got) == want and len(got) == len(want)


def test_trie_without_turns_or_rows(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], CONV)).count() == 0
    gone = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(gone, 0, "user", "a", 1, "x"), (gone, 1, "user", "b", 1, "x")]
    (root,) = prefix_trie.conversation_trie(spark.createDataFrame(rows, CONV)).collect()
    assert tuple(root) == (gone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(gone).encode()).hexdigest())


def test_merge_compares_from_the_shared_turns_on(monkeypatch):
    rng = random.Random(3)
    names = [b"".join(bytes([rng.randint(0, 2)]) * 16 for _ in range(rng.randint(0, 12))) for _ in range(500)]
    runs = [prefix_trie.sorted_run([(x, i, np.zeros(len(x) // 16)) for i, x in enumerate(names) if i % 7 == r]) for r in range(7)]
    compared, plain = [], prefix_trie.shared_turns
    monkeypatch.setattr(prefix_trie, "shared_turns", lambda a, b, known: compared.append((plain(a, b, 0), known)) or plain(a, b, known))
    got = list(prefix_trie.merged(runs))
    assert [(x, i) for _, x, i, _ in got] == sorted((x, i) for i, x in enumerate(names))
    assert all(k == plain(b[1], x, 0) for (k, x, *_), b in zip(got[1:], got, strict=False))
    assert all(known <= real for real, known in compared) and len(compared) < 500 * 3
