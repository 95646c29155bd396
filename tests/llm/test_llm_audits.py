"""Filter audit, token store and source divergence against brute force on small and awkward inputs."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import combinations, permutations
from math import factorial

import numpy as np
import pytest

from sieveline.llm import filter_audit, source_divergence, token_store
from sieveline.llm.common import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, part string, digest int, tie string, n string, term string"
RARE = " ".join(f"w{i}x" for i in range(150))
DULL = " ".join(f"w{i % 40}y" for i in range(150))
TEXTS = [
    (5, RARE, "en", "a"),
    (3, RARE, "fr", "a"),
    (3, RARE, "fr", "a"),
    (9, RARE, None, None),
    (None, RARE, "en", "a"),
    (None, None, "en", "b"),
    (1, None, "en", "b"),
    (2, "", "de", "c"),
    (4, DULL, "en", "b"),
    (6, DULL + " #", "en", "b"),
    (7, RARE.upper(), "en", "a"),
    (8, "A\x0bB\x0cC É漢字 ß", "en", "a"),
    (10, f"{RARE} $ {DULL}", "en", "c"),
    (11, " ".join(f"v{i}{'é' * (i % 3)}" for i in range(40_000)), "en", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, lang, source, "clash", 1, "x", "y", "z") for i, t, lang, source in TEXTS], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_masks():
    ids = defaultdict(list)
    for i, t, *_ in TEXTS:
        if i is not None:
            ids[t or ""].append(i)
    out = []
    for i, t, lang, _ in TEXTS:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        failed = (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and i > min(ids[t]))
        out.append((i, lang or "", {f for f, x in zip("ABCDE", failed, strict=True) if x}))
    return out


def test_filter_audit_equals_brute_force(spark, docs, none):
    labels = spark.createDataFrame([(5, 1, 0), (5, 0, 1), (3, 1, 1), (4, 0, 1), (None, 1, 1), (77, 1, 1), (6, None, None), (9, 1, None)], "doc_id long, quality int, toxic int")
    good, toxic = {5, 3, 9}, {5, 3, 4}
    want, masks = [], brute_masks()
    for part in {p for _, p, _ in masks}:
        mine = [(i, failed) for i, p, failed in masks if p == part]
        removed_by = Counter()
        rows = []
        for order in permutations("ABCDE"):
            for step, letter in enumerate(order, 1):
                earlier = set(order[: step - 1])
                now = [i for i, failed in mine if letter in failed and not failed & earlier]
                removed_by[letter] += len(now)
                rows.append([part, "".join(order), step, sum(not failed & (earlier | {letter}) for _, failed in mine), len(now), sum(letter in failed and bool(failed & earlier) for _, failed in mine), sum(failed == {letter} for _, failed in mine), sum(i in good for i in now), sum(i in toxic for i in now)])
        want += [tuple([*r, removed_by[r[1][r[2] - 1]]]) for r in rows]
    found = filter_audit.audit_filters(docs, labels)
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert filter_audit.audit_filters(none, labels).count() == 0
    unlabelled = filter_audit.audit_filters(docs, labels.limit(0))
    assert unlabelled.count() == len(want) and unlabelled.where("good_lost > 0 OR toxic_lost > 0").isEmpty()


def test_removal_polynomial_is_the_multilinear_extension():
    rng = random.Random(4)
    counts = {m: rng.randint(0, 9) for m in range(32)}
    r = filter_audit.RemovalPolynomial(counts)
    removed = lambda fs: sum(n for m, n in counts.items() if any(m >> f & 1 for f in fs))
    for k in range(6):
        for fs in combinations(range(5), k):
            assert r.at(sum(1 << f for f in fs)) == removed(fs)
    for i in range(5):
        others = [f for f in range(5) if f != i]
        want = sum(Fraction(factorial(k) * factorial(4 - k), 120) * (removed([*fs, i]) - removed(fs)) for k in range(5) for fs in combinations(others, k))
        assert r.shapley(i) == want
    # A step of the derivative by hand: two filters that fail together.
    assert filter_audit.RemovalPolynomial({0b11: 6}).diagonal_derivative(0) == {0: 6, 1: -6}


def test_words_are_counted_over_blocks():
    rng = random.Random(2)
    raw = b"".join(rng.choice([b"ab", b"c", b" ", b"\n", b"\x0b", "é".encode()]) for _ in range(3000))
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    assert {filter_audit.word_counts(raw, block) for block in (1, 7, 100, 10_000)} == {(len(words), len(set(words)))}


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))


def stored(ids):
    return [*ids, 0]


def test_chunks_give_the_identifiers_of_whole_texts():
    lib, encode, rng = library(), token_store.ChunkEncoder(tokenizer_path("byte_bpe_50k.json"), bound=40), random.Random(3)
    units = [*"aAbB  zZ\n\t\x1c\x85 　éÉΣ漢한²'!?<|>😀\0", "<|endoftext|>", "'s", " the", "  ", " \n"]
    texts = ["".join(rng.choice(units) for _ in range(rng.randint(0, 25))) for _ in range(4000)]
    for at in range(0, len(texts), 100):
        some = texts[at : at + 100]
        for t, raw in zip(some, encode(some), strict=True):
            assert np.frombuffer(raw, "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)
    assert encode([None, ""]) == [b"", b""]


def test_words_with_marks_are_encoded_by_their_pieces(monkeypatch):
    lib, encode = library(), token_store.ChunkEncoder(tokenizer_path("byte_bpe_50k.json"))
    texts = ["Über the ciónñta###\nOf. x'll it's a,b 4.0.\nOf <|endoftext|> c", "the the,\nthe! été.", "", "a  b \n c", ",[^漢^ \n\nÀ]\n\nb\n c"] * 3
    learned = []
    learn = encode.learn
    monkeypatch.setattr(encode, "learn", lambda new: learned.extend(new) or learn(new))
    got = encode(texts[1:3])
    assert not any(c.isalpha() for x in learned for c in x)  # only marks need a pass of the whole library
    assert got == [encode.whole("the the,\nthe! été."), b""]
    for t, raw in zip(texts, encode(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)


def test_store_gives_back_every_document_in_order(spark, docs, none, tmp_path):
    lib = library()
    want = sorted(((i, stored(lib.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in TEXTS), key=lambda x: (x[0] is not None, x))
    path = str(tmp_path / "store")
    token_store.write_store(docs, path, shard_bytes=300, ranges=3)
    found = token_store.read_store(spark, path, "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<long>").collect()
    found.sort(key=lambda r: r.start)
    assert [r.start for r in found] == np.cumsum([0, *[r.n_tokens for r in found[:-1]]]).tolist()
    assert [r.doc_id for r in found] == [i for i, _ in want]
    assert sorted((r.doc_id or -1, r.ids) for r in found) == sorted((i or -1, ids) for i, ids in want)
    assert all(r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in found)
    opened = token_store.TokenStore(path)
    assert len(opened.shards) > 3 and {s.name for s in opened.shards} == {p.stem for p in (tmp_path / "store").glob("*.bin")}
    assert [x.tolist() for x in opened.get(3)] == [ids for i, ids in want if i == 3]
    assert opened.get(12) == []
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        some = token_store.read_store(spark, path).where("doc_id IN (3, 8, 99)")
        assert sorted(r.doc_id for r in some.collect()) == [3, 3, 8]
        assert token_store.read_store(spark, path).where("doc_id = 12").count() == 0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert token_store.stored_documents(none).count() == 0


def test_store_refuses_another_dictionary(docs, tmp_path):
    path = str(tmp_path / "store")
    token_store.write_store(docs, path, ranges=2)
    (tmp_path / "store" / "dictionary").write_bytes(b"other")
    with pytest.raises(ValueError, match="dictionary"):
        token_store.TokenStore(path)


def test_commit_drops_what_lost_attempts_left(docs, tmp_path, monkeypatch):
    path = tmp_path / "store"
    path.mkdir()
    (path / "part-00000000-lost.bin").write_bytes(b"half")
    token_store.write_store(docs, str(path), ranges=2)
    assert not list(path.glob("*lost*"))
    assert sum(s.docs for s in token_store.TokenStore(str(path)).shards) == len(TEXTS)


def test_trained_dictionary_helps_short_documents():
    import zstandard

    rng = np.random.default_rng(1)
    phrases = [rng.integers(0, 50_000, 12).astype("<u2").tobytes() for _ in range(300)]
    piece = lambda: b"".join(phrases[i] for i in rng.integers(0, 300, 20))
    raw = token_store.trained_dictionary([piece() for _ in range(2000)], 16_384)
    docs = [piece()[:240] for _ in range(50)]
    size = lambda **o: sum(len(zstandard.ZstdCompressor(level=3, **o).compress(d)) for d in docs)
    assert size(dict_data=token_store.codec_dictionary(raw)) < 0.5 * size()
    assert token_store.trained_dictionary([], 100) == b"" and token_store.codec_dictionary(b"") is None


def brute_divergence(rows, least):
    count, df, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sources[lang].add(source)
        count[lang, source].update(terms)
        df[lang].update(set(terms))
    out = []
    for lang, names in sources.items():
        kept = [t for t, d in df[lang].items() if d >= least]
        counts = {s: {t: count[lang, s][t] for t in kept} for s in names}
        counts[None] = {t: sum(count[lang, s][t] for s in names) for t in kept}
        p = {s: {t: 1 + 1_000_000_000 * (c + 5) // (sum(mine.values()) + 5 * len(kept)) for t, c in mine.items()} for s, mine in counts.items()}
        for s in names:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in names - {s}))
            terms = sorted((p[None][t] - p[s][t], t.encode()) for t in kept if counts[s][t] and p[s][t] > p[None][t])[:50]
            for part, items in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, o.decode(), -v, k) for k, (v, o) in enumerate(items, 1)]
    return sorted(out)


def test_divergence_equals_brute_force(spark, docs, none):
    rng = random.Random(8)
    words = [f"{a}{b}" for a in "aäbcdeéfgh漢" for b in "klmnopqrs"]
    rows = []
    for k in range(400):
        lang, source = rng.choice(["en", "en", "en", "fr", None]), rng.choice([None, "s1", "s2", "s3", "é", "z"])
        text = " ".join(rng.choice(words[: rng.choice([20, 60, 99])]) for _ in range(rng.choice([0, 3, 40])))
        rows.append((rng.choice([text, text.upper(), text.replace(" ", "-3")]) if k % 50 else None, lang, source))
    rows += [("only here", "xx", "one"), (None, "yy", "one"), ("", "yy", "two")]
    frame = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    found = source_divergence.source_divergence(frame, least_docs=8)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, found.collect())) == brute_divergence(rows, 8)
    assert sorted(map(tuple, source_divergence.source_divergence(docs, least_docs=2).collect())) == brute_divergence([(t, lang, s) for _, t, lang, s in TEXTS], 2)
    assert source_divergence.source_divergence(none).count() == 0


def test_partial_counts_and_blocks_add_up(spark, docs, monkeypatch):
    whole = source_divergence.kept_terms(source_divergence.term_counts(docs), least_docs=1)
    small = source_divergence.kept_terms(source_divergence.term_counts(docs, held=7), least_docs=1, block_rows=3)
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, small.collect()))
    raw = "Äb cd\x00EF漢7gh ".encode() * 50
    monkeypatch.setattr(source_divergence, "BLOCK", 10)
    assert [t for ts in source_divergence.terms_of(raw) for t in ts] == ["Äb".encode(), b"cd", "ef漢".encode(), b"gh"] * 50
