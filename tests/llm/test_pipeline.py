import random
import re

from tokenizers import Tokenizer

import corpus_pipeline
from meterlark.llm import mixing
from meterlark.llm.common import materialise
from meterlark.llm.language import has_letter
from meterlark.llm.queries import tokenizer_path
from tests.conftest import SMALL
from tests.llm.helpers import documents

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_stages_take_effect(spark):
    docs = documents(spark).unionByName(spark.createDataFrame([(900, "... 123", "en", "src0", 7), (901, None, "en", "src1", 0)], documents(spark).schema))
    kept, names = docs, []
    plain = Tokenizer.from_file(tokenizer_path())
    for name, stage in corpus_pipeline.STAGES:
        before, kept = kept, materialise(stage(spark, kept, SMALL), name)
        names.append(name)
        if name == "language_id":
            assert before.count() - kept.count() == 2
            assert all(has_letter(r.text) for r in kept.collect())
        if name == "near_dedup":
            assert sorted(r.doc_id for r in kept.collect()) == _stay([(r.doc_id, r.text) for r in before.orderBy("doc_id").collect()])
        if name == "decontamination":
            items = [_words(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
            windows = {tuple(w[i : i + 10]) for w in items if w for i in range(max(1, len(w) - 9))}
            hit = lambda t: any(tuple(w[i : i + 10]) in windows for w in [_words(t)] for i in range(len(w)))
            assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in before.collect() if not hit(r.text)}
        if name == "source_mixing":
            copies, plan = kept.groupBy("doc_id").count().toPandas().set_index("doc_id")["count"], mixing.rated(before).toPandas().set_index("doc_id")
            assert (plan.copies[plan.copies > 0].sort_index() == copies.sort_index()).all()
            by = plan.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
            assert (abs(by.taken - by.target) <= 0.02 * by.target + 50).all()
        if name == "token_output":
            ids = [len(plain.encode(r.text, add_special_tokens=False).ids) + 1 for r in before.orderBy("doc_id").collect()]
            assert [r.n_tokens for r in kept.orderBy("doc_id", "start").collect()] == ids
        if name != "token_output":
            assert kept.columns == docs.columns
    assert names == ["language_id", "near_dedup", "decontamination", "source_mixing", "token_output"]
    assert kept.count() == before.count()


def test_run(spark):
    got = corpus_pipeline.run(spark, SMALL)
    assert got.count() > 0 and got.columns[:4] == ["doc_id", "start", "n_tokens", "ids_crc32"]


def _stay(rows):
    """Ids that stay when all pairs of texts with five-word Jaccard of 0.8 are linked."""
    sets = []
    for _, text in rows:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    part = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            n = len(a & b)
            if part[i] != part[j] and n >= 0.8 * (len(a) + len(b) - n) - 1e-9:
                part = [part[j] if p == part[i] else p for p in part]
    return sorted(min(i for (i, _), p in zip(rows, part) if p == q) for q in set(part))


def near_copies():
    """Texts with scattered, appended, trimmed and block edits, and a group that shares a boilerplate."""
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(3000)]
    draw = lambda n: rng.choices(vocabulary, [1 / (k + 1) for k in range(3000)], k=n)
    texts = []
    for n in (40, 90, 300):
        for share in (0.02, 0.1, 0.18, 0.21, 0.3):
            for _ in range(4):
                base, k = draw(n), max(1, int(share * n))
                at = rng.randrange(n - k)
                texts += [base, base + draw(k), base[k:], base[:at] + draw(k // 2 + 1) + base[at + k // 2 + 1 :]]
                scattered = list(base)
                for i in rng.sample(range(n), max(1, k // 5)):
                    scattered[i] = "edited"
                texts.append(scattered)
    passage = draw(60)
    texts += [passage + draw(rng.randrange(2, 30)) for _ in range(60)]
    chain = draw(200)
    texts += [chain[8 * i :] + draw(8 * i) for i in range(12)]
    rng.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_near_dedup_against_all_pairs(spark):
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SMALL).collect()) == _stay(rows)
