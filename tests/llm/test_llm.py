import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tesserae.llm import _common, chat_format, decontaminate, exact_dedup, jaccard_join, langid, mixing, quality, sharding, token_count, toxicity
from tesserae.llm._common import crc_mod, text_chunks, work_dir
from tesserae.llm.queries import oracle_sql, queries

SF = Path("/root/testdata/sf0.001")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
DOCS_NAMES = ["doc_id", "text", "lang", "source", "n_chars"]
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
# nulls in every column, empty and long texts, ties, repeated rows
ROWS = [
    (1, "The cat sat on the mat.", "en", "a", 23), (2, "the CAT sat on the mat.", "en", "a", 23), (2, "the CAT sat on the mat.", "en", "a", 23), (3, None, "en", None, None), (4, "", None, "b", 0),
    (None, "no id here", "en", "b", 10), (None, None, None, None, None), (5, " \n\t ", "fr", "b", 4), (6, "É é ß 日本 1 !", "fr", "c", 11), (7, "word " * 30_000, "en", "c", 150_000), (8, "x", "de", None, 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    """With extra columns whose names operators use themselves."""
    df = spark.createDataFrame(ROWS, DOCS)
    for name in ("score", "size", "node", "kept", "digest", "shard", "_n", "taken", "items"):
        df = df.withColumn(name, F.lit("mine"))
    return df


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, None, 1), (2, 0, None), (None, 1, 1), (99, 0, 1)], "doc_id long, quality int, toxic int")


def none_of(docs):
    return docs.filter("1 = 0")


def test_toxicity(spark, docs, labels):
    rng = random.Random(3)
    clean = [" ".join(rng.choice("alpha beta gamma delta omega".split()) for _ in range(12)) + "." for _ in range(80)]
    texts = [c + (" You vile idiot. " if k % 2 else " ") + c for k, c in enumerate(clean)]
    model = toxicity.train(texts, np.arange(80) % 2)
    scores = toxicity.score_texts(pa.array([*texts, None, ""]), model)
    assert ((scores[:80] >= 0.5) == (np.arange(80) % 2 == 1)).all() and (scores[80:] == 0).all()
    found = toxicity.locate(spark, spark.createDataFrame([(1, texts[1]), (2, texts[0])], "doc_id long, text string"), model).collect()
    assert [(r["doc_id"], r["sentence"]) for r in found] == [(1, 1)] and texts[1].encode()[found[0]["start"] : found[0]["end"]].decode().strip() == "You vile idiot."
    out = toxicity.score_documents(docs, labels.filter("toxic = 1")).collect()  # one class only: nothing learned
    assert len(out) == len(ROWS) and all(r["score"] == 0 and r["predicted"] == 0 for r in out)
    assert all(r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 5 == 0) for r in out)
    assert toxicity.score_documents(none_of(docs), none_of(labels)).count() == 0
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns
    again = spark.createDataFrame([(2, "b", "x"), (2, "a", "x"), (2, None, "x"), (2, "c", "y"), (7, None, "x")], "doc_id long, text string, lang string")
    for df in (again, again.orderBy(F.desc("text"))):  # repeated ids give one text, in whatever order they come
        texts, y = toxicity.labelled_sample(df, spark.createDataFrame([(2, 1), (7, 0)], "doc_id long, toxic int"), "toxic", F.lit(False), 5)
        assert texts == ["c", ""] and y.tolist() == [1, 0]


def test_toxicity_is_trained_by_a_task_and_not_by_the_driver(spark, monkeypatch):
    rng = random.Random(5)
    clean = [" ".join(rng.choice("alpha beta gamma delta omega".split()) for _ in range(12)) + "." for _ in range(80)]
    docs = spark.createDataFrame([(k, c + (" You vile idiot. " if k % 2 else " ") + c) for k, c in enumerate(clean)] + [(80, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(81)], "doc_id long, toxic int")
    texts, y = toxicity.labelled_sample(docs, labels, "toxic", crc_mod(F.col("doc_id"), 5) == 0, 1500)
    real, driver = toxicity.train, os.getpid()
    whole = real(texts, y)

    def train(texts, labels):
        assert os.getpid() != driver or not len(texts), "the driver holds the texts"
        return real(texts, labels)

    monkeypatch.setattr(toxicity, "train", train)
    model = toxicity.fit(docs, labels)
    assert model.trained and model.bias == whole.bias and whole.weights.any() and (model.weights == whole.weights).all()


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_training_samples_are_bounded_in_bytes(spark):
    rows = [(k, "x" * (50 if k % 3 else 1000), "ab"[k % 2], "s", 0) for k in range(60)]
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame([(k, 0, k % 2) for k in range(60)], "doc_id long, quality int, toxic int")
    texts, y = toxicity.labelled_sample(docs, labels, "toxic", F.lit(False), 30, 400)
    assert all(len(t) == 50 for t in texts) and sum(map(len, texts)) <= 800 and len(texts) == 16 and y.sum() == 8
    assert langid.fit(docs, 5, 4, 10_000).languages == ["a", "b"]
    assert langid.fit(docs, 5, 4, 10).languages == []  # every text is too long


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_language_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = queries()["op6_language"](spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("lang IS NOT NULL").select("lang_pred", "lang").collect()
    assert len(got) > 100 and sum(a == b for a, b in got) / len(got) >= 0.95


@pytest.mark.parametrize("name, column, least", [("op1_toxicity", "toxic", 0.85), ("op3_quality", "quality", 0.9)])
def test_held_out_accuracy(spark, name, column, least):
    sf = "/root/testdata/sf0.01"
    got = queries()[name](spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("predicted", column).collect()
    assert len(got) > 20 and sum(a == b for a, b in got) / len(got) >= least


def test_toxicity_scores_are_the_noisy_or_of_sentences(spark):
    """Brute force: sentences by a regular expression, one logit each from the model's weights, word by word."""
    rng = random.Random(8)
    clean = [" ".join(rng.choice("alpha beta gamma delta omega".split()) for _ in range(9)) for _ in range(60)]
    model = toxicity.train([c + (". You vile idiot! " if k % 2 else ". ") + c for k, c in enumerate(clean)], np.arange(60) % 2)
    texts = ["You vile idiot! Alpha beta.  Idiot?\nomega é. vile", "", None, "no end", "... !?", "a.b vile"]

    def brute(text):
        stay, found = 1.0, []
        pieces = [(m.start(), m[0]) for m in re.finditer(r"[^\x20\x09-\x0D]+", text or "")]
        sentences, last = [], -1
        for at, word in pieces:
            if last < 0 or re.search(r"[!.?\n]", (text or "")[last:at]):
                sentences.append([])
            sentences[-1].append((at, word))
            last = at
        for k, words in enumerate(sentences):
            z = model.bias
            for _, w in words:
                data = np.frombuffer(w.encode(), dtype=np.uint8)
                for h in toxicity.Words(data, np.array([0, len(data)])).hashes(*toxicity.CUTS):
                    z += float(model.weights[int(h[0] >> np.uint64(64 - toxicity.BITS))])
            p = 1 / (1 + np.exp(-z))
            stay *= 1 - p
            if p >= 0.5:
                found.append((k, len((text or "")[: words[0][0]].encode()), len((text or "")[: words[-1][0]].encode()) + len(words[-1][1].encode())))
        return 1 - stay, found

    score, found = toxicity.score_and_locate(pa.array(texts), model)
    for k, t in enumerate(texts):
        want, where = brute(t)
        assert score[k] == pytest.approx(want, abs=1e-6)
        mine = found.row == k
        assert list(zip(found.sentence[mine].tolist(), found.start[mine].tolist(), found.end[mine].tolist(), strict=True)) == where
    assert len(found.row) >= 2


def test_quality(spark, docs, labels):
    out = quality.score_documents(docs, labels).collect()
    assert len(out) == len(ROWS) and all(0 <= r["score"] <= 1 for r in out)
    assert {r["score"] for r in quality.score_documents(docs, none_of(labels)).collect()} == {0.5}
    assert quality.score_documents(none_of(docs), labels).count() == 0
    x, y = quality.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]), np.ones(4))
    assert x.tolist() == [1, 2.5, 4] and y.tolist() == [0, 0.5, 1]


def test_quality_statistics_and_scores_by_brute_force():
    texts = ["Aa bb. Aa!\nAa bb. Aa!\nx", "", "é 12 | 34 \"q\"", "THE END of extraordinarilylong words of of"]
    space = re.compile(r"[^\x20\x09-\x0D]+")
    got = quality.statistics(pa.array(texts))
    at = quality.NAMES.index
    for row, t in zip(got, texts, strict=True):
        raw, words = t.encode(), space.findall(t.translate(ASCII))
        size, n = max(1, len(raw)), max(1, len(words))
        lines = [tuple(w) for w in (space.findall(x.translate(ASCII)) for x in t.split("\n")) if w]
        want = {
            "upper": sum(65 <= b <= 90 for b in raw) / size, "lower": sum(97 <= b <= 122 for b in raw) / size, "digit": sum(48 <= b <= 57 for b in raw) / size, "wide": sum(b >= 128 for b in raw) / size, "full_stop": raw.count(b".") / size,
            "log_bytes": np.log1p(len(raw)), "log_words": np.log1p(len(words)), "word_length": sum(len(w.encode()) for w in words) / n, "long_words": sum(len(w.encode()) > 14 for w in words) / n, "short_words": sum(len(w.encode()) < 3 for w in words) / n,
            "again": sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, "distinct_words": len(set(words)) / n, "distinct_lines": len(set(lines)) / max(1, len(lines)), "line_words": len(words) / max(1, len(lines)) / 100,
        }
        assert {k: pytest.approx(float(row[at(k)]), abs=1e-9) for k in want} == want
    rng = np.random.default_rng(1)
    model = quality.QualityModel(got.mean(axis=0), np.maximum(got.std(axis=0), 1e-6), rng.normal(size=quality.FEATURES + 1), np.array([-1.0, 0.0, 1.0]), np.array([0.0, 0.2, 1.0]))
    draws = np.random.Generator(np.random.PCG64(7))
    project, phase = draws.normal(size=(len(quality.NAMES), quality.FEATURES)) / np.sqrt(len(quality.NAMES)) * 0.7, draws.uniform(0, 2 * np.pi, quality.FEATURES)
    for row, score in zip(got, model.score(got), strict=True):
        x = np.clip((row - model.mean) / model.spread, -6, 6)
        raw = sum(np.sqrt(2 / quality.FEATURES) * np.cos(x @ project[:, k] + phase[k]) * model.weights[k] for k in range(quality.FEATURES)) + model.weights[-1]
        assert score == pytest.approx(np.clip(np.interp(raw, [-1, 0, 1], [0, 0.2, 1]), 0, 1))


def test_statistics_do_not_depend_on_chunks(monkeypatch):
    texts = ["Aa bb. Aa!\nAa bb. Aa!\nx", None, "", "é 12 | 34", "q"]
    whole = quality.statistics(pa.array(texts))
    monkeypatch.setattr(quality, "CHUNK", 4)
    assert np.allclose(whole, quality.statistics(pa.array(texts)))
    assert whole[0][quality.NAMES.index("distinct_lines")] == pytest.approx(2 / 3)


def _mix_brute(rows, weights=(5, 2, 1)):
    sized = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, s in rows]
    sources = sorted({s for _, s, _ in sized}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for _, x, n in sized if x == s) for s in sources}
    w, target, fixed = {s: weights[k % 3] for k, s in enumerate(sources)}, {}, set()
    while True:
        rest = sum(total.values()) - sum(3 * total[s] for s in fixed)
        target = {s: 3 * total[s] if s in fixed else rest * w[s] / sum(w[x] for x in sources if x not in fixed) for s in sources}
        over = {s for s in sources if s not in fixed and target[s] > 3 * total[s]}
        if not over:
            return total, target
        fixed |= over


def test_mixing(spark, docs, monkeypatch):
    total, target = _mix_brute([(r[0], r[1], r[3]) for r in ROWS])
    for per_bucket in (1, 20_000):
        out = mixing.mix_sources(docs, rows_per_bucket=per_bucket).collect()
        assert len(out) == len(ROWS)
        by = defaultdict(int)
        for r in out:
            assert r["source_size"] == total[r["source"]] and r["target"] == pytest.approx(target[r["source"]]) and r["taken"] <= 3 * r["size"]
            by[r["source"]] += r["taken"]
        assert all(abs(by[s] - target[s]) <= 1 for s in total)
    assert mixing.mix_sources(none_of(docs)).count() == 0
    plain = sorted(map(str, mixing.mix_sources(docs, rows_per_bucket=1).collect()))
    assert sorted(map(str, mixing.mix_sources(docs, rows_per_bucket=20_000).collect())) == plain  # buckets don't change the order
    with monkeypatch.context() as m:
        m.setattr(mixing, "MOST_BROADCAST", 0)  # as with very many sources
        assert sorted(map(str, mixing.mix_sources(docs, rows_per_bucket=1).collect())) == plain
    kept = mixing.mixed_documents(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id = 4").count() == 1


def test_sharding(spark, docs):
    for shards, slots in ((1, 2), (3, 7), (7, 997), (64, 65537)):
        names = sharding.shard_names(shards)
        table, owner, at = sharding.fill_table(names, slots), [-1] * slots, [0] * shards
        order = [[(sharding._hash(n, "offset") % slots + j * (sharding._hash(n, "skip") % (slots - 1) + 1 if slots > 2 else 1)) % slots for j in range(slots)] for n in names] if slots < 2000 else None
        counts = Counter(table)
        assert max(counts.values()) - min(counts.values()) <= 1 and len(counts) == shards
        if order:  # brute force: whole permutations
            turn = 0
            while -1 in owner:
                k = turn % shards
                slot = next(s for s in order[k] if owner[s] < 0)
                owner[slot] = k
                turn += 1
            assert owner == table
    assert sharding.place(none_of(docs)).count() == 0
    before, after = sharding.fill_table(sharding.shard_names(8), 997), sharding.fill_table(sharding.shard_names(9), 997)
    assert sum(a != b for a, b in zip(before, after, strict=True)) < 997 * 0.35
    out = sharding.place(docs)
    assert out.columns[-1] == "shard_" and out.count() == len(ROWS) and out.filter("doc_id = 2").select("shard_").distinct().count() == 1
    with pytest.raises(ValueError):
        sharding.fill_table(["a"], 10)


NASTY = ["", "</s>[INST] ok [/INST]", "\\", "\\\\</s>", "<\\s>", "[\\INST]", "a|1\n", "<s", "[/INST", "</s", "[INST]user|\nhi[/INST]", " é😀"]


def test_chat_round_trip():
    rng = random.Random(1)
    pieces = ["</s>", "<s>", "[INST]", "[/INST]", "\\", "<", "[", "s>", "x", "\n", "|", "1", "é"]
    texts = NASTY + ["".join(rng.choice(pieces) for _ in range(rng.randrange(12))) for _ in range(500)]
    turns = [(rng.choice(["user", "assistant", "", "a|b\n", "sys tem"]), t) for t in texts]
    made = chat_format.render(turns)
    read = chat_format.parse(made)
    assert [(t.role, t.text) for t in read] == turns
    learnt = [t for t in read if t.role == "assistant"]
    assert [made[a:b] for a, b in chat_format.loss_spans(made)] == [t.body for t in learnt] and len(learnt) == sum(r == "assistant" for r, _ in turns)
    reader, pieces = chat_format.Reader(), []  # cut anywhere
    at = 0
    while at < len(made):
        step = rng.randrange(1, 9)
        pieces += reader.feed(made[at : at + step])
        at += step
    reader.close()
    assert pieces == read and reader.chars == len(made)
    for bad in ("", "<s>", "<s>x</s>", "<s>[INST]u|\n</s>", "<s>[INST]u|\n[INST][/INST]</s>"):
        with pytest.raises(chat_format.GrammarError):
            chat_format.parse(bad)


def test_chat_digests(spark):
    rows = [(1, 1, "assistant", "b</s>"), (1, 0, "user", None), (1, 1, "assistant", "b</s>"), (2, None, None, "x"), (None, 0, "user", "n"), (2, 0, "assistant", "\\")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    got = {r["conv_id"]: r for r in chat_format.conversation_digests(chat_format.format_turns(df)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1]["n_turns"] == 3 and got[1]["turns_sha256"] == sha("user\n\nassistant\nb</s>\nassistant\nb</s>\n") and got[1]["loss_chars"] == 10 and got[1]["loss_sha256"] == sha("b</s>b</s>")
    assert got[2]["turns_sha256"] == sha("\nx\nassistant\n\\\n") and got[None]["loss_sha256"] == sha("")
    assert chat_format.conversation_digests(chat_format.format_turns(none_of(df))).count() == 0
    long = [(7, k, "assistant" if k % 2 else "user", f"</s> {k} " * (3000 if k == 5 else 3)) for k in range(400)]  # a long conversation with a very long text
    made = chat_format.format_turns(spark.createDataFrame(long, "conv_id long, turn long, role string, text string"))
    under = {r["turn"]: r["formatted"][r["mask_start"] : r["mask_end"]] for r in made.filter("mask_start IS NOT NULL").collect()}
    assert sorted(under) == list(range(1, 400, 2)) and all(chat_format.unescape(x) == long[k][3] for k, x in under.items())
    got = chat_format.conversation_digests(made).collect()
    loss = "".join(t for _, _, r, t in long if r == "assistant")
    assert [(r["n_turns"], r["loss_chars"], r["loss_sha256"], r["turns_sha256"]) for r in got] == [(400, len(loss), sha(loss), sha("".join(f"{r}\n{t}\n" for _, _, r, t in long)))]
    assert got[0]["formatted_chars"] == len(chat_format.render([(r, t) for _, _, r, t in long]))


def test_language(spark, docs, monkeypatch):
    syllables = {"aa": "ou eau les", "ab": "ou eux lez", "ba": "sch ung der", "bb": "sch ich den"}
    rng = random.Random(2)
    texts, langs = zip(*[(" ".join(rng.choice(s.split()) for _ in range(40)), k) for k, s in syllables.items() for _ in range(30)], strict=True)
    model = langid.train(list(texts), list(langs))
    assert sorted(map(sorted, model.families)) == [[0, 1], [2, 3]]
    with monkeypatch.context() as m:
        m.setattr(langid, "DENSE", 0)  # as with many languages
        sparse = langid.train(list(texts), list(langs))
    assert sparse.families == model.families and np.allclose(sparse.between, model.between, atol=1e-2) and np.allclose(sparse.family, model.family, atol=1e-2)
    names, score = langid.predict(pa.array([*texts, None, "", "12 !", "Ω"]), model)
    assert sum(a == b for a, b in zip(names, langs, strict=False)) >= 0.95 * len(langs) and names[-4:-1] == ["und"] * 3 and names[-1] != "und"
    out = langid.predict_documents(docs).collect()
    assert len(out) == len(ROWS) and all(0 <= r["score"] <= 1 for r in out) and {r["lang_pred"] for r in out if r["doc_id"] in (3, 4, 5)} == {"und"}
    assert {r["lang_pred"] for r in langid.predict_documents(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.predict_documents(none_of(docs)).count() == 0
    again = [(k, t, c, "s", 0) for k, (t, c) in enumerate(zip(texts, langs, strict=True))] + [(1, texts[0], "zz", "s", 0), (1, texts[0], None, "s", 0), (None, texts[0], "zz", "s", 0)]
    df = spark.createDataFrame(again, DOCS)  # of a repeated doc_id the first lang counts
    assert langid.fit(df, 50).languages == sorted(syllables) and langid.fit(df.filter("doc_id IS NULL")).languages == []
    a, b = (sorted(map(str, langid.predict_documents(x, 7).collect())) for x in (df, df.orderBy(F.desc("text")).repartition(5)))
    assert a == b


def test_language_votes_by_brute_force():
    """Relative frequencies of byte trigrams and four-grams in a table, the family of the greatest margin, then votes."""
    syllables = {"aa": "ou eau les", "ab": "ou eux lez", "ac": "ou eaz lex", "ba": "sch ung der", "bb": "sch ich den"}
    rng = random.Random(6)
    made = [(" ".join(rng.choice(s.split()) for _ in range(30)), k) for k, s in syllables.items() for _ in range(20)]
    model = langid.train(*map(list, zip(*made, strict=True)))
    texts = [t for t, _ in made[::7]] + ["Ou, EAU! les 12 lez é", "der den sch", "12"]
    names, score = langid.predict(pa.array([*texts, texts[0] * 400]), model)

    def slot(gram):
        h = (int.from_bytes(gram, "big") * 0x9E3779B97F4A7C15 + len(gram)) * 0xD6E8FEB86659FD93 % 2**64
        return h >> (64 - langid.BITS)

    for text, name, sure in zip(texts, names, score, strict=False):
        raw = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in text.lower().encode())
        grams = Counter(slot(raw[a : a + w]) for w in (3, 4) for a in range(len(raw) - w + 1) if raw[a : a + w].strip(b" "))
        x = np.zeros((1 << langid.BITS) + 1)
        for k, n in grams.items():
            x[k] = n / grams.total() * np.sqrt(1 << langid.BITS)
        x[-1] = 1
        if not re.search("[a-z]", text.lower()):
            assert name == "und" and sure == 0
            continue
        family = model.families[int(np.argmax(x @ model.family))]
        wins, sums = Counter(), Counter()
        for j, (a, b) in enumerate(model.pairs):
            if a in family:
                z = x @ model.between[:, j]
                wins[a if z > 0 else b] += 1
                sums[a] += z
                sums[b] -= z
        assert name == model.languages[max(family, key=lambda k: (wins[k], sums[k], -k))]


def _dedup_brute(rows):
    norm = [(r[0], (r[1] or "").translate(ASCII)) for r in rows]
    groups = defaultdict(list)
    for d, t in norm:
        groups[t].append(d)
    top = {t: max((d for d in ds if d is not None), default=None) for t, ds in groups.items()}
    return sorted((str(d), str(top[t]), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for d, t in norm), len(groups)


def _dedup_rows(out):
    return sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in out)


@pytest.mark.parametrize("digest, broadcast", [(exact_dedup.sha256_digest, 2_000_000), (exact_dedup.sha256_digest, 0), (lambda t: F.lit("same"), 2_000_000), (lambda t: F.substring(F.sha2(t.cast("binary"), 256), 1, 1), 0)])
def test_exact_dedup(spark, docs, tmp_path, monkeypatch, digest, broadcast):
    """Also with digests that stand for several texts, with joined hits, and with groups in parts."""
    monkeypatch.setattr(exact_dedup, "HITS_BROADCAST", broadcast)
    monkeypatch.setattr(exact_dedup, "GROUP_ROWS", 2)
    docs.repartition(3).write.parquet(str(tmp_path / "d"))
    out = exact_dedup.deduplicate_path(spark, str(tmp_path / "d"), 1, digest).collect()
    want, groups = _dedup_brute(ROWS)
    assert _dedup_rows(out) == want
    assert sum(r["kept"] for r in out) == groups


def test_exact_dedup_without_a_keeper(spark, docs, tmp_path):
    path = str(tmp_path / "d")
    docs.write.parquet(path)
    state = exact_dedup.run_stream(exact_dedup.document_stream(spark, path), locator=F.lit("gone"))
    out = exact_dedup.deduplicate(spark.read.parquet(path), state, locator=F.col("_metadata.file_path")).collect()
    want, groups = _dedup_brute(ROWS)
    assert _dedup_rows(out) == want and sum(r["kept"] for r in out) == groups


def test_exact_dedup_goes_on_from_its_state(spark, docs, tmp_path):
    more = [(9, "NO ID HERE", "en", "b", 10), (10, "new", "en", "b", 3), (1, "The cat sat on the mat.", "en", "a", 23)]
    path, state = str(tmp_path / "d"), str(tmp_path / "state")
    docs.select(*DOCS_NAMES).repartition(2).write.parquet(path)
    assert _dedup_rows(exact_dedup.deduplicate_path(spark, path, 1, state_dir=state).collect()) == _dedup_brute(ROWS)[0]
    changes = lambda: {p.name for p in (tmp_path / "state" / "changes").iterdir() if p.name.startswith("batch=")}
    before = changes()
    spark.createDataFrame(more, DOCS).write.mode("append").parquet(path)
    out = exact_dedup.deduplicate_path(spark, path, 1, state_dir=state).collect()
    want, groups = _dedup_brute([*ROWS, *more])
    assert _dedup_rows(out) == want and sum(r["kept"] for r in out) == groups
    # the second run saw the three new rows only, and added them to what it had
    assert sum(spark.read.parquet(str(tmp_path / "state" / "changes" / p)).count() for p in changes() - before) == 3


def test_exact_dedup_of_nothing(spark, docs, tmp_path):
    none_of(docs).write.parquet(str(tmp_path / "e"))
    assert exact_dedup.deduplicate_path(spark, str(tmp_path / "e")).count() == 0


def _leaks_brute(docs, items, phrase):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for i, t in items:
        w = word.findall((t or "").translate(ASCII))
        for a in range(len(w) - min(phrase, len(w)) + 1) if w and i is not None else ():
            windows[tuple(w[a : a + min(phrase, len(w))])].add(i)
    out = []
    for t in docs:
        w = word.findall((t or "").translate(ASCII))
        hit, found = set(), set()
        for k in {len(x) for x in windows}:
            for a in range(len(w) - k + 1):
                if owners := windows.get(tuple(w[a : a + k])):
                    found |= owners
                    hit |= set(range(a, a + k))
        out.append((len(w), len(hit), sorted(found)))
    return out


def test_fm_index_against_brute_force():
    for seed in range(40):
        rng = random.Random(seed)
        vocabulary = ["a", "b", "c", "the", "é1", "Foo"][: rng.randrange(1, 7)]
        items = [(rng.randrange(9), " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(9)))) for _ in range(rng.randrange(5))]
        texts = [", ".join(rng.choice([*vocabulary, *["zz"] * rng.randrange(2)]) for _ in range(rng.randrange(60))) for _ in range(20)] + ["", None]
        shard = decontaminate.Shard(decontaminate.make_block([i for i, _ in items], [t for _, t in items], 4))
        for row, data, off in text_chunks(pa.array(texts, pa.large_string()), 200):
            shard.add(pa.array(range(row, row + len(off) - 1)), data, off)
        got = shard.result().to_pylist()
        assert [(r["n_words"], sum(e - s for s, e in zip(r["starts"], r["ends"], strict=True)), r["items"]) for r in got] == _leaks_brute(texts, items, 4)


@pytest.mark.parametrize("block_words", [3, 1 << 20])
def test_contamination(spark, docs, block_words):
    items = [(1, "the cat sat"), (11, "SAT on the mat"), (2, None), (3, ""), (None, "word word"), (5, "word " * 6), (1, "x")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("starts", F.lit(0))
    out = decontaminate.contamination(docs, bench, 4, block_words).collect()
    want = _leaks_brute([r[1] for r in ROWS], items, 4)
    digest = lambda found: hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in out) == sorted((str(r[0]), w, h, len(f), digest(f)) for r, (w, h, f) in zip(ROWS, want, strict=True))
    assert all(r["contaminated"] == (r["n_hit"] > 0 and 20 * r["n_hit"] >= r["n_words"]) for r in out)
    assert decontaminate.contamination(none_of(docs), bench).count() == 0 and decontaminate.contamination(docs, none_of(bench)).filter("n_hit > 0").count() == 0
    kept = decontaminate.drop_contaminated(docs, bench, 4)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {None, 3, 4, 5, 6}


@pytest.mark.parametrize("block_words", [3, 1 << 20])
def test_spans_below_the_share_are_cut(spark, block_words):
    item = [f"w{k}" for k in range(20)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "tiny item")], "item_id long, text string")
    filler = lambda n, of: " ".join(f"{of}{k}" for k in range(n))
    inside = ", ".join(item[:7]) + " - " + ", ".join(item[:13]) + " ... " + ", ".join(item[7:13])  # cut once, the outer words are a phrase
    rows = [
        (1, f"É {filler(500, 'a')}.  ({' '.join(item).upper()})!\n{filler(400, 'b')}\t", "en", "a", 0), (2, f"{inside} {filler(700, 'c')} Tiny, ITEM", "en", "a", 0),
        (3, " ".join(item), "en", "a", 0), (4, " \n clean  É\t" + " ".join(item[:12]), "en", "a", 7), (5, None, "en", None, None),
    ]
    docs = spark.createDataFrame(rows, DOCS).withColumn("starts", F.lit("mine"))
    assert sorted(tuple(r)[:5] for r in decontaminate.drop_contaminated(docs, bench, 13, block_words).collect()) == [rows[3], rows[4]]
    out = decontaminate.cut_contaminated(docs, bench, 13, block_words)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r for r in out.collect()}
    assert sorted(got) == [1, 2, 4, 5]
    assert got[1]["text"] == f"É {filler(500, 'a')}.  ()!\n{filler(400, 'b')}\t" and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"].split() == filler(700, "c").split()
    assert tuple(got[4])[:5] == rows[3] and tuple(got[5])[:5] == rows[4]
    assert {r["starts"] for r in got.values()} == {"mine"}


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_no_benchmark_window_is_left_by_the_stage(spark):
    import corpus_pipeline

    docs = spark.read.parquet(str(SF / "documents.parquet"))
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(str(SF / "benchmark.parquet")).collect()]
    words = [f"v{k}" for k in range(2000)]
    late = spark.createDataFrame([(-k, " ".join([*words[: 50 * k], items[k][1], *words]), "en", "a", 0) for k in range(1, 9)], docs.schema)
    before = {r["doc_id"]: r["text"] for r in docs.unionByName(late).collect()}
    after = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_contaminated(spark, docs.unionByName(late), str(SF)).collect()}
    leaks = dict(zip(before, _leaks_brute(before.values(), items, 13), strict=True))
    assert all(leaks[d][1] > 0 for d in range(-8, 0)) and any(20 * leaks[d][1] < leaks[d][0] for d in range(-8, 0))
    assert after == {d: before[d] for d, (_, h, _) in leaks.items() if h == 0}


def _components_brute(rows, n, num, den):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(ASCII))
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and den * common >= num * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((str(d), len(sets[i]), str(least.get(find(i))) if sets[i] else str(d)) for i, (d, _) in enumerate(rows))


def _near_copies(rng, groups=6, copies=12):
    rows, k = [], 100
    for _ in range(groups):
        base = [rng.choice("abcdefghijklmnop") + str(rng.randrange(40)) for _ in range(rng.randrange(5, 120))]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = "new" + str(rng.randrange(1000))
            rows.append((k, " ".join(w)))
            k += 1
    return rows


@pytest.mark.parametrize("n, num, den, cell, long_list, broadcast", [(3, 90, 100, 2048, 200_000, 1_000_000), (2, 6, 10, 5, 200_000, 1_000_000), (3, 8, 10, 4, 2, 1_000_000), (2, 7, 10, 7, 2, 0)])
def test_jaccard_join(spark, docs, monkeypatch, n, num, den, cell, long_list, broadcast):
    """Also with cells cut into chunks, and with lists led without gathering them."""
    monkeypatch.setattr(jaccard_join, "SAMPLED", 64 if long_list > 2 else 1)
    monkeypatch.setattr(jaccard_join, "MOST_BROADCAST", broadcast)
    rows = [(r[0], r[1]) for r in ROWS] + _near_copies(random.Random(n))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(1)).withColumn("leader", F.lit("x"))
    out = jaccard_join.jaccard_components(df, n, num, den, cell_rows=cell, long_list=long_list).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in out) == _components_brute(rows, n, num, den)


def test_jaccard_join_of_nothing_and_keep_one(spark, docs):
    assert jaccard_join.jaccard_components(none_of(docs), 3, 90, 100).count() == 0
    kept = jaccard_join.keep_one(docs, 5, 8, 10)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "3", "4", "None", "None", "5", "6", "7", "8"])


def test_the_driver_gives_freed_memory_back(spark, monkeypatch):
    said = []
    monkeypatch.setattr(jaccard_join, "stored", lambda df, path, real=jaccard_join.stored: said.append(None) or real(df, path))
    monkeypatch.setattr(_common, "give_back", lambda spark, real=_common.give_back: said.append(real(spark)))
    jaccard_join.connected_components(spark.createDataFrame([(1, 2), (2, 3)], "a long, b long"), work_dir(spark, "components"))
    assert len(said) == 3 and (said[2] is None or "RSS" in said[2])  # two writes, and a release after the round
    monkeypatch.undo()
    monkeypatch.setattr(_common, "TRIM", "noSuchCommand")
    assert _common.give_back(spark) is None  # a JVM without it goes on


def test_components_take_no_round_once_there_are_stars_only(spark, monkeypatch):
    rng, written, real = random.Random(7), [], jaccard_join.stored
    monkeypatch.setattr(jaccard_join, "stored", lambda df, path: written.append(path) or real(df, path))

    def components(links):
        written.clear()
        df = spark.createDataFrame(links, "a long, b long")
        return {r["node"]: r["component"] for r in jaccard_join.connected_components(df, work_dir(spark, "components")).collect()}

    assert components([]) == {} and components([(1, 1)]) == {}
    assert components([(9, 1), (1, 9), (1, 7), (5, 4), (3, 3)]) == {9: 1, 7: 1, 5: 4} and len(written) == 1  # stars from the first
    assert components([(1, 3), (2, 3)]) == {3: 1, 2: 1} and len(written) == 2  # two lower ends
    assert components([(1, 2), (2, 3)]) == {3: 1, 2: 1} and len(written) == 2  # an upper end that is a lower one
    chain = list(range(40))
    rng.shuffle(chain)
    links = list(zip(chain, chain[1:])) + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)]
    least = {v: v for pair in links for v in pair}
    for _ in least:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    assert components(links) == {v: c for v, c in least.items() if v != c}


def test_row_decisions_with_null_and_repeated_ids(spark):
    text = lambda of, n=40: " ".join(f"{of}{k}" for k in range(n))
    a, b, c, d = (text(x) for x in "abcd")
    rows = [(None, a), (None, a), (None, a + " more"), (None, b), (5, c), (5, c), (5, d), (4, d + " more"), (7, text("e")), (7, text("e") + " more"), (None, text("e")), (None, None), (8, "")]
    docs = spark.createDataFrame([(i, t, "en", "a", k) for k, (i, t) in enumerate(rows)], DOCS).withColumn("_id", F.lit("mine")).withColumn("key", F.lit("mine"))
    kept = jaccard_join.keep_one(docs, 5, 8, 10)
    assert kept.columns == docs.columns
    got = [(r["doc_id"], (r["text"] or "")[:1]) for r in kept.collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(None, "a"), (None, "b"), (5, "c"), (4, "d"), (7, "e"), (None, ""), (8, "")]))

    bench = spark.createDataFrame([(1, text("a", 13)), (2, text("c", 13))], "item_id long, text string")
    clean = decontaminate.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns
    assert sorted(r["n_chars"] for r in clean.collect()) == [3, *range(6, 13)]


@pytest.mark.parametrize("num, den", [(90, 100), (8, 10), (1, 2)])
def test_cells_skip_blocks_and_lose_no_link(num, den):
    rng = np.random.default_rng(num)
    skipped = compared = pairs = 0
    for _ in range(60):
        common = rng.integers(0, 2**40, 60, dtype=np.uint64)  # a passage of all members
        sets = []
        for _ in range(rng.integers(1, 6)):
            base = np.union1d(common, rng.integers(0, 2**40, rng.integers(5, 120), dtype=np.uint64))
            sets += [np.union1d(base[rng.random(len(base)) > rng.random() * 0.2], rng.integers(0, 2**40, rng.integers(0, 4), dtype=np.uint64)) for _ in range(rng.integers(1, 8))]
        sets = [x for x in sets if len(x)]
        side = rng.integers(0, 2, len(sets)) if rng.random() < 0.3 else np.zeros(len(sets), dtype=int)
        side[0] = 2 if side.any() else 0
        cell = jaccard_join.Cell(list(range(len(sets))), sets, side, 0, num, den)
        root = list(range(len(sets)))
        find = lambda i: i if root[i] == i else find(root[i])
        for i, j in cell.run():
            root[find(i)] = find(j)
        for i in range(len(sets)):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                due = not side.any() or side[i] != side[j]
                if den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                    assert not due or find(i) == find(j)
                elif cell.lists is not None:
                    pairs += 1
        if cell.lists is not None:
            skipped, compared = skipped + cell.lists.skipped, compared + cell.compared
            assert cell.lists.read + cell.lists.skipped > 0
    assert skipped > 0 and compared < pairs  # the passage puts all members into a cell, but most pairs are never compared


@pytest.mark.parametrize("num, den", [(90, 100), (8, 10), (2, 5)])
def test_bitmaps_lose_no_similar_pair(num, den):
    rng = np.random.default_rng(den)
    for _ in range(40):
        sets, side = [], []
        for _ in range(rng.integers(1, 6)):
            base = np.unique(rng.integers(0, 2**64, rng.integers(1, 1500), dtype=np.uint64))
            for _ in range(rng.integers(1, 4)):
                sets.append(np.union1d(base[rng.random(len(base)) > rng.random() * 0.3], rng.integers(0, 2**64, 1, dtype=np.uint64)))
                side.append(int(rng.integers(0, 2)))
        size, side = np.array([len(x) for x in sets]), np.array(side) if rng.random() < 0.5 else np.zeros(len(sets), dtype=int)
        near = jaccard_join.near_bitmaps([jaccard_join.bitmap(x) for x in sets], size, side, num, den)
        similar = lambda i, j: den * len(np.intersect1d(sets[i], sets[j])) >= num * len(np.union1d(sets[i], sets[j])) and (not side.any() or side[i] != side[j])
        for i in range(len(sets)):
            if any(similar(i, j) for j in range(len(sets)) if j != i):
                assert near[i]
    far = [np.unique(rng.integers(0, 2**64, 2000, dtype=np.uint64)) for _ in range(30)]
    assert not jaccard_join.near_bitmaps([jaccard_join.bitmap(x) for x in far], np.array([len(x) for x in far]), np.zeros(30, dtype=int), 8, 10).any()


def test_similar_sets_always_share_a_list():
    rng = np.random.default_rng(5)
    for num, den in ((90, 100), (8, 10), (1, 2)):
        positions = jaccard_join.Positions(num, den)
        for _ in range(300):
            x = np.unique(rng.integers(0, 2**64, rng.integers(1, 200), dtype=np.uint64))
            y = x[rng.random(len(x)) > rng.random() * 0.3]
            y = np.union1d(y, rng.integers(0, 2**64, rng.integers(0, 1 + len(x) // 8), dtype=np.uint64))
            common = len(np.intersect1d(x, y))
            if common and den * common >= num * (len(x) + len(y) - common):
                assert set(positions.signatures(x).tolist()) & set(positions.signatures(y).tolist())


def test_token_counts_equal_the_tokenizers_library(spark, docs, monkeypatch):
    from tokenizers import Tokenizer, models, pre_tokenizers

    def theirs(vocabulary, byte_fallback):
        t = Tokenizer(models.Unigram(vocabulary, 0, byte_fallback))
        t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Metaspace()])
        return lambda s: len(t.encode(s, add_special_tokens=False).ids)

    rng = random.Random(4)
    vocabulary = token_count.read_vocabulary()
    texts = [r[1] for r in ROWS if r[1] and len(r[1]) < 1000] + ["".join(rng.choice("ab ▁éß日\x1c\x85\n<s>😀zq") for _ in range(rng.randrange(30))) for _ in range(400)]
    for fallback in (True, False):
        ours, want = token_count.Counter(vocabulary, fallback), theirs(vocabulary, fallback)
        assert [ours.text(t) for t in texts] == [want(t) for t in texts]
        assert ours.texts(pa.array([*texts, None, *texts])).tolist() == [*map(want, texts), 0, *map(want, texts)]
        with monkeypatch.context() as m:
            m.setattr(token_count, "CACHE", 5)  # chunks are forgotten all the time
            assert token_count.Counter(vocabulary, fallback).texts(pa.array(texts)).tolist() == [*map(want, texts)]
    for seed in range(20):  # small vocabularies with many ties
        rng.seed(seed)
        small = list({"<unk>": 0.0, **{"".join(rng.choice("▁abc") for _ in range(rng.randrange(1, 4))): -float(rng.randrange(1, 4)) for _ in range(12)}}.items())
        ours, want = token_count.Counter(small, False), theirs(small, False)
        for _ in range(50):
            s = "".join(rng.choice("abcd ") for _ in range(12))
            assert ours.text(s) == want(s)
    out = token_count.count_tokens(docs).collect()
    assert len(out) == len(ROWS) and {r["n_tokens"] for r in out if r["doc_id"] in (3, 4, 5)} == {0}
    assert token_count.count_tokens(none_of(docs)).count() == 0


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for p in SF.iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.execute(oracle_sql()[name]).fetchall()
    columns = [d[0] for d in con.description]
    df = queries()[name](spark, str(SF))
    assert sorted(df.columns) == sorted(columns)
    assert sorted(str(tuple(r)) for r in df.select(*columns).collect()) == sorted(map(str, want))


def _tables(tmp_path, spark, docs, labels, bench):
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", bench)):
        df.coalesce(2).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_pipeline_on_odd_tables(spark, docs, tmp_path):
    import corpus_pipeline

    item = " ".join(f"w{k}" for k in range(20))
    text = lambda of, n=60: " ".join(f"{of}{k}" for k in range(n))
    extra = [(20, text("p") + " " + item, "en", "a", 0), (21, text("q"), "en", "a", 0), (22, text("q") + " more", "en", "b", 0), (21, text("q"), "en", "a", 0), (None, text("r"), None, None, None), (None, text("r"), None, None, None), (None, text("s") + " " + item, "en", "a", 0)]
    mine = [c for c in docs.columns if c not in DOCS_NAMES]
    more = spark.createDataFrame(extra, DOCS).select(*DOCS_NAMES, *[F.lit("mine").alias(c) for c in mine])
    labels = spark.createDataFrame([(1, 1, 0), (None, None, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, item), (None, "no id here"), (2, None)], "item_id long, text string")
    path = _tables(tmp_path, spark, docs.unionByName(more), labels, bench)
    out = corpus_pipeline.run(spark, path)
    assert out.columns == [*docs.columns, "shard_"] and all(r[c] == "mine" for r in out.collect() for c in mine)
    got = Counter((r["doc_id"], (r["text"] or "")[:4]) for r in out.collect())
    # clean, one of each group of near copies (rows without words stay), no benchmark passage; each as often as its source's budget takes it
    assert set(got) <= {(1, "The "), (3, ""), (4, ""), (None, "no i"), (None, ""), (5, " \n\t "[:4]), (6, "É é "), (7, "word"), (8, "x"), (21, "q0 q"), (None, "r0 r")}
    assert {(3, ""), (4, ""), (None, "")} <= set(got) and max(got.values()) <= 3
    assert (20, "p0 p") not in got and (None, "s0 s") not in got and (22, "q0 q") not in got and (2, "the ") not in got


def test_pipeline_of_nothing(spark, docs, labels, tmp_path):
    import corpus_pipeline

    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    path = _tables(tmp_path, spark, none_of(docs), none_of(labels), none_of(bench))
    out = corpus_pipeline.run(spark, path)
    assert out.columns == [*docs.columns, "shard_"] and out.count() == 0


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_stages_against_brute_force(spark):
    """Each stage on what its predecessor kept."""
    import corpus_pipeline

    docs, sf = spark.read.parquet(str(SF / "documents.parquet")), str(SF)
    rows = lambda df: [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    source = rows(docs)
    scores = toxicity.score_texts(pa.array([t for _, t, _ in source], pa.large_string()), model)
    calm = corpus_pipeline.drop_toxic(spark, docs, sf).cache()
    assert sorted(rows(calm)) == sorted(r for r, s in zip(source, scores, strict=True) if s < 0.5) and 0 < calm.count() < docs.count()
    one = corpus_pipeline.keep_one_of_near_copies(spark, calm, sf).cache()
    near = _components_brute([r[:2] for r in rows(calm)], 5, 8, 10)
    assert sorted(r[0] for r in rows(one)) == sorted(int(d) for d, n, c in near if n == 0 or d == c)
    clean = corpus_pipeline.drop_contaminated(spark, one, sf).cache()
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    left = [r for r, (_, h, _) in zip(rows(one), _leaks_brute([r[1] for r in rows(one)], items, 13), strict=True) if h == 0]
    assert sorted(rows(clean)) == sorted(left)
    mixed = rows(corpus_pipeline.mix_sources(spark, clean, sf))
    # by hand: sources in order of their random keys, whole epochs, then up to the budget; a part of a document counts from half
    total, target = _mix_brute([(d, t, s) for d, t, s in left])
    want = Counter()
    for s in total:
        mine = sorted(((hashlib.md5(str(d).encode()).hexdigest(), d, len(re.findall(r"[^\x20\x09-\x0D]+", t))) for d, t, x in left if x == s))
        budget = int(target[s] + 0.5)
        epochs, rest = divmod(budget, total[s]) if total[s] else (0, 0)
        for _, d, n in mine:
            part = max(0, min(n, rest))
            rest -= part
            want[d] += int((epochs * n + part) / n + 0.5) if n else 1
    assert Counter(d for d, _, _ in mixed) == +want
    shards = corpus_pipeline.place_in_shards(spark, clean, sf).collect()
    table = sharding.fill_table(sharding.shard_names())
    assert len(shards) == len(left) and all(r["shard"] == table[int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:15], 16) % len(table)] for r in shards)


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(str(SF / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(SF))
    assert out.columns == [*docs.columns, "shard"]
    got = out.collect()
    ids = {r["doc_id"] for r in got}
    stage = docs
    model_kept = {r["doc_id"] for r in toxicity.drop_toxic(docs, spark.read.parquet(str(SF / "labels.parquet"))).select("doc_id").collect()}
    rows = [(r["doc_id"], r["text"]) for r in stage.filter(F.col("doc_id").isin(sorted(model_kept))).collect()]
    one = {int(d) for d, n, c in _components_brute(rows, 5, 8, 10) if n == 0 or d == c}
    leaks = dict(zip([d for d, t in rows if d in one], _leaks_brute([t for d, t in rows if d in one], [(r["item_id"], r["text"]) for r in spark.read.parquet(str(SF / "benchmark.parquet")).collect()], 13), strict=True))
    clean = {d for d, (_, h, _) in leaks.items() if h == 0}
    assert ids <= clean and len(ids) >= 0.5 * len(clean)
    assert max(Counter(r["doc_id"] for r in got).values()) <= 3
