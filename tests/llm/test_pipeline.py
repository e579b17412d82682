"""All five stages on small odd tables: nulls, repeats, empty and long texts, each stage against a plain version."""

import itertools
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import langid, pii, toxicity
from tessera.llm.encoding import encoder

EN, DE = "the and of with this that was have from they but not".split(), "der und nicht ist eine auch für über schön ich aber kein".split()


def written(seed, words, n):
    return " ".join(np.random.default_rng(seed).choice(words, n))


def rows():
    out = [(k, written(k, EN if k % 2 else DE, 60) + (" vile moronic" if k % 7 == 0 else ""), "en" if k % 2 else "de", "s", 5) for k in range(140)]
    base = written(900, EN, 120).split()
    out += [(300 + k, " ".join(base[:k] + ["other"] + base[k + 1 :]), "en", "s", 5) for k in range(3, 9)] + [(310, " ".join(base), None, "s", None), (311, " ".join(base).upper(), "en", None, 1)]
    out += [(400, None, "en", "s", 0), (401, "", None, "s", 0), (402, "12 ²", "de", "s", 4), (403, written(5, DE, 6000), "de", "s", 9)]
    out += [(500, written(77, EN, 50) + " mail ann@example.com or +1 (988) 555-2485", "en", "s", 9)] * 2
    out += [(501, written(78, EN, 50), "en", "s", 9), (501, written(79, EN, 50), "en", "s", 9), (None, written(80, DE, 50), "de", "s", 9), (None, written(80, DE, 50), "de", "s", 9)]
    return out


KIND = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows(), KIND).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 7 == 0)) for k in range(140)] + [(None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def once(docs):
    """One row of each group: the brute force of the third stage."""
    sets = []
    for r in docs:
        w = (r.text or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    group = list(range(len(docs)))
    for a, b in itertools.combinations(range(len(docs)), 2):
        both = len(sets[a] & sets[b])
        if docs[a].doc_id is None or docs[b].doc_id is None:
            continue
        if docs[a].doc_id == docs[b].doc_id or sets[a] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = group[a], group[b]
            group = [x if g == y else g for g in group]
    best = {}
    for r, g in zip(docs, group):
        key = (r.doc_id is None, r.doc_id, r.text)
        best[g] = min(best.get(g, (key, r)), (key, r), key=lambda p: p[0])
    return Counter(tuple(r) for _, r in best.values())


def test_each_stage_keeps_what_it_should(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language ID", "toxicity", "near-duplicates", "PII", "best-fit packing"]

    def run(name, df):
        out = stages[name](spark, df, tables)
        assert out.schema.names[:0] == [] and (name == "best-fit packing" or out.columns == docs.columns)
        return spark.createDataFrame(found := out.collect(), out.schema), found

    before = docs.collect()
    model = langid.fit(docs)
    df, after = run("language ID", docs)
    lang, _, unsure = model.predict([r.text for r in before])
    assert Counter(map(tuple, after)) == Counter(tuple(r) for r, x, u in zip(before, lang, unsure) if x != "und" and not u)
    assert {400, 401, 402}.isdisjoint({r.doc_id for r in after}) and len(after) > 140

    before, model = after, toxicity.fit(df, spark.read.parquet(f"{tables}/labels.parquet"))
    df, after = run("toxicity", df)
    assert Counter(map(tuple, after)) == Counter(tuple(r) for r, s in zip(before, model.score([r.text for r in before])) if s < 0.5)
    assert not any("vile" in r.text for r in after) and len(after) >= 120

    before = after
    df, after = run("near-duplicates", df)
    assert Counter(map(tuple, after)) == once(before)
    assert sum(r.doc_id == 500 for r in after) == 1 >= sum(r.doc_id == 501 for r in after) and sum(300 <= (r.doc_id or 0) <= 311 for r in after) < 8

    before, plain = after, {(r.doc_id, r.text): r for r in after}
    df, after = run("PII", df)
    changed = {r.doc_id for r in after if (r.doc_id, r.text) not in plain}
    assert changed == {500} and Counter(r.doc_id for r in after) == Counter(r.doc_id for r in before)
    hidden = next(r for r in after if r.doc_id == 500)
    assert "ann@example.com" not in hidden.text and "988" not in hidden.text and hidden.n_chars == len(hidden.text)
    assert hidden.text == pii.replace(spark.createDataFrame([r for r in before if r.doc_id == 500], KIND)).first().text

    before = after
    df, after = run("best-fit packing", df)
    tokenizer = encoder("byte_bpe_50k.json").tokenizer
    want = Counter((r.doc_id, zlib.crc32(np.array([*tokenizer.encode(r.text, add_special_tokens=False).ids, 0], "<u4").tobytes())) for r in before)
    whole = defaultdict(bytes)
    for r in sorted((r for r in after if r.doc_id is not None), key=lambda r: (r.doc_id, r.piece)):
        whole[r.doc_id] += r.ids
    assert {(i, zlib.crc32(x)) for i, x in whole.items()} == {k for k in want if k[0] is not None}
    places = defaultdict(list)
    for r in after:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        ends = [0, *itertools.accumulate(n for _, n in sorted(own))]
        assert [o for o, _ in sorted(own)] == ends[:-1] and ends[-1] <= 2048


def test_empty_tables(spark, tables, tmp_path):
    for name, kind in (("documents", KIND), ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
