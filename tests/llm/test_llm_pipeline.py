"""The pipeline's stages on a small corpus."""

from __future__ import annotations

import random

import corpus_pipeline
from test_llm_operators import brute_leaks, brute_lines, brute_links

from sieveline.llm import quality_classifier
from sieveline.llm.common import tokenizer_path


def corpus():
    rng = random.Random(11)
    vocabulary = [f"{a}{b}" for a in ("lo", "mi", "ta", "re", "su", "na", "ke") for b in ("ran", "tel", "vos", "dim", "ler", "pon")] + "the of and to in".split()
    sentence = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ",", "."]) for _ in range(n))
    docs = [(i, "\n".join(sentence(25) for _ in range(4))) for i in range(120)]
    passage, leak = sentence(70), sentence(30)
    docs += [(200, docs[3][1]), (201, docs[4][1].replace(" ", "  ", 1)), (202, f"{sentence(40)}\n{passage}"), (203, f"{passage}\n{sentence(40)}"), (204, f"{sentence(60)} {leak} {sentence(20)}")]
    near = docs[7][1].split(" ")
    near[30] = "changed"
    docs.append((205, " ".join(near).replace("\n", " ")))
    docs += [(300 + i, " ".join(rng.choice(vocabulary) + "&&&" for _ in range(50))) for i in range(30)]
    docs += [(400, None), (401, "")]
    return docs, passage, leak


def test_stages(spark, tmp_path):
    docs, passage, leak = corpus()
    d = str(tmp_path)
    spark.createDataFrame([(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i < 300), 0) for i, _ in docs if i < 400], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    frame, seen = spark.read.parquet(f"{d}/documents.parquet"), {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        columns = frame.columns
        stage(spark, frame, d).write.parquet(f"{d}/{n}")
        frame = spark.read.parquet(f"{d}/{n}")
        seen[name] = {r.doc_id: r.asDict() for r in frame.collect()}
        assert name == "packing" or frame.columns == columns
    assert not [i for i in seen["quality_classifier"] if 300 <= i < 400]
    assert set(range(120)) <= set(seen["quality_classifier"])
    lines = seen["line_dedup"]
    assert 200 not in lines and passage in lines[202]["text"] and passage not in lines[203]["text"]
    assert lines[203]["n_chars"] == len(lines[203]["text"]) and lines[5]["text"] == dict(docs)[5]
    one = seen["ngram_jaccard_join"]
    assert 205 not in one and 7 in one and set(range(120)) <= set(one)
    clean = seen["benchmark_decontamination"]
    assert 204 not in clean and set(one) - set(clean) == {204}
    assert set(seen["packing"]) == set(clean)


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, removed string, __doc long, __spans int, row string, copy int, key string, spans string, raw double"


def test_each_stage_equals_brute_force_on_its_input(spark, tmp_path):
    """With null and equal ids, empty texts, long runs and columns whose names the operators use."""
    from tokenizers import Tokenizer

    made, passage, leak = corpus()
    made += [(None, made[5][1]), (None, f"no id but {leak}"), (3, f"another text of id three {made[9][1]}"), (204, made[10][1] + " changed"), (204, made[10][1] + " changed")]
    d, stages = str(tmp_path), dict(corpus_pipeline.STAGES)
    extra = ("x", 1, 2, "r", 3, "k", "s", 0.5)
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), *extra) for i, t in made], CLASHING).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i < 300), 0) for i, _ in made if i is not None and i < 400], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    frames = [spark.read.parquet(f"{d}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, frames[-1], d).write.parquet(f"{d}/{name}")
        frames.append(spark.read.parquet(f"{d}/{name}"))
        assert name == "packing" or frames[-1].schema.simpleString() == frames[0].schema.simpleString()
    pairs = [sorted(((r.doc_id, r.text) for r in f.collect()), key=repr) for f in frames[:5]]
    labels = spark.read.parquet(f"{d}/labels.parquet")
    scored = quality_classifier.score_documents(frames[0].select(frames[0].text.alias("doc_id"), "text"), labels.limit(0))
    assert scored.count() == len(made) and len(pairs[1]) < len(made)
    weights = quality_classifier.train(frames[0], labels)
    raw = {(r.doc_id, r.text): r.score for r in frames[0].select("doc_id", "text", quality_classifier.raw_score(frames[0].text, weights).alias("score")).collect()}
    assert min(raw[p] for p in pairs[1]) > max(raw[p] for p in pairs[0] if p not in pairs[1])
    # 2. Rows of equal doc_id are ordered by the hash of their text.
    copies = {(r.doc_id, r.text): (r.doc_id, r.copy) for r in frames[1].selectExpr("doc_id", "text", "xxhash64(text) AS copy").collect()}
    cleaned = brute_lines({copies[p]: p[1] for p in pairs[1] if p[0] is not None})
    want = [(i, cleaned[copies[i, t]] if i is not None else t) for i, t in pairs[1]]
    assert pairs[2] == sorted(((i, t) for (i, t), before in zip(want, pairs[1], strict=True) if t == before[1] or t.split()), key=repr)
    # 3. One document of each class stays: the least doc_id, then the least hash of the text.
    copies = {(r.doc_id, r.text): r.copy for r in frames[2].selectExpr("doc_id", "text", "xxhash64(text) AS copy").collect()}
    named = [((i, copies[i, t]) if i is not None else None, t) for i, t in pairs[2]]
    least = brute_links(named)
    assert pairs[3] == [p for p, (own, first, _) in zip(pairs[2], least, strict=True) if own is None or own == first]
    # 4. Rows go by their own text, without a doc_id too.
    hits = brute_leaks([(1, leak)], texts=pairs[3])
    assert pairs[4] == [p for p, hit in zip(pairs[3], hits, strict=True) if not hit[1]] and any(hit[1] and p[0] is None for p, hit in zip(pairs[3], hits, strict=True))
    # 5. Every id of every text is packed once.
    lib = Tokenizer.from_file(tokenizer_path())
    packed = frames[5].groupBy().sum("length").first()[0]
    assert packed == sum(len(lib.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in pairs[4])
    # Empty tables.
    for name, stage in stages.items():
        assert stage(spark, frames[0].limit(0), d).count() == 0, name


def test_run_gives_the_packed_pieces(spark):
    pieces = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert pieces.count() > 0 and "sequence_id" in pieces.columns
