"""The fused posterior against a plain computation, and accuracy on noisy evidence."""

import random
import time

import numpy as np

from gleanery.llm import langid

SYLLABLES = {"en": ["the", "and", "tion", "er", "ing", "ough"], "fr": ["eau", "é", "que", "tion", "ment", "oi"], "de": ["sch", "ung", "ü", "ein", "der", "tz"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def tables(spark, rng):
    docs = [(i, text(rng, lang, 60), lang) for i, lang in enumerate(rng.choice(list(SYLLABLES)) for _ in range(120))]
    pages, truth = [], {}
    for i in range(200):
        lang = rng.choice(list(SYLLABLES))
        host = f"h{rng.randint(0, 3)}.{'one' if lang == 'en' else 'two'}.{'com' if lang == 'en' else lang}"
        declared = lang if rng.random() < 0.8 else rng.choice(list(SYLLABLES))
        body = text(rng, lang, rng.choice([0, 1, 30]))
        pages.append((i, f"http://{host}/p?q={i}", f'<html lang="{declared}"><script>the the</script><p>{body}</p>'))
        truth[i] = lang
    pages += [(900, None, None), (901, "nonsense", ""), (901, "nonsense", ""), (None, "http://h0.one.com/", "<html><p>the and</p>")]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, language string"), truth


def test_fusion(spark):
    docs, pages, truth = tables(spark, random.Random(1))
    got = langid.identify(pages, docs).collect()
    assert len(got) == pages.count() and all(0 < r.probability <= 1.0000001 for r in got)
    right = sum(truth[r.page_id] == r.language for r in got if r.page_id in truth)
    assert right >= 0.95 * len(truth)
    assert right >= sum(truth[r.page_id] == r.text_language for r in got if r.page_id in truth)


def test_against_plain(spark):
    docs, pages, _ = tables(spark, random.Random(2))
    languages, table = langid.learn_text(docs)
    n, rows = len(languages), pages.collect()
    likely = []
    for r in rows:
        g = langid.trigrams(langid.visible(r.html or ""))
        total = table[:, g].sum(1, dtype=np.float64) if len(g) else np.zeros(n)
        likely.append((total - total.max()) * min(1.0, langid.MOST_EVIDENCE / max(len(g), 1)))
    logs = np.array(likely)
    own = np.exp(logs) / np.exp(logs).sum(1, keepdims=True)
    import re

    host = [(re.match(r"^[a-z]+://([^/?#:]*)", r.url or "") or [None, ""])[1] for r in rows]
    keys = {"suffix": [h.split(".")[-1] for h in host], "domain": [".".join(h.split(".")[-2:]) for h in host], "host": host, "declared": [(re.search('<html lang="([a-z]+)', r.html or "") or [None, ""])[1] for r in rows]}
    for i, r in enumerate(rows):
        norm = lambda x: x / x.sum()
        prior = norm(np.maximum(own.sum(0) - own[i], 0) + 1.0 / n)
        for level in ("suffix", "domain", "host"):
            same = np.array([k == keys[level][i] for k in keys[level]])
            prior = norm(np.maximum(own[same].sum(0) - own[i], 0) + langid.PRIOR_PAGES * prior)
        same = np.array([k == keys["declared"][i] for k in keys["declared"]])
        said = (np.maximum(own[same].sum(0) - own[i], 0) + langid.DECLARED_PAGES / n / n) / (np.maximum(own.sum(0) - own[i], 0) + langid.DECLARED_PAGES / n)
        rows[i] = (r.page_id, norm(np.exp(logs[i]) * prior * said).max())
    got = [(r.page_id, r.probability) for r in langid.identify(pages, docs).collect()]
    order = lambda x: sorted(x, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    for (a, p), (b, q) in zip(order(rows), order(got), strict=True):
        assert a == b and abs(p - q) < 1e-6


def test_text_model_of_counts(spark):
    """Counts added up in tasks give what counting the texts one after the other gives, for many languages."""
    rng = random.Random(9)
    docs = [(i, "".join(rng.choices("abcdé ", k=rng.randint(0, 60))), f"l{i % 37}") for i in range(300)] + [(900, "", "none"), (901, None, "null"), (902, "text", None)]
    languages, table = langid.learn_text(spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(5))
    assert languages == sorted({f"l{k}" for k in range(37)} | {"none"})
    for k, lang in enumerate(languages):
        row = np.full(langid.BUCKETS, 0.1)
        for _, text, of in docs:
            if of == lang:
                row += np.bincount(langid.trigrams(langid.visible(text)), minlength=langid.BUCKETS)
        assert np.allclose(table[k], np.log(row / row.sum()), atol=1e-6)


def test_no_labels_and_empty(spark):
    docs, pages, _ = tables(spark, random.Random(3))
    assert {r.language for r in langid.identify(pages, docs.limit(0)).collect()} == {"und"}
    assert langid.identify(pages.limit(0), docs).count() == 0


def test_every_language_is_known(spark):
    """250 languages, one of them with most of the documents, one with long ones only."""
    rng = random.Random(4)
    docs = [(k, f"mot{k} " * 20, f"l{k:03d}") for k in range(250)] + [(1000 + i, "the and " * 10, "hot") for i in range(2000)] + [(9000, "largo texto " * 5000, "long")]
    rng.shuffle(docs)
    languages, table = langid.learn_text(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    assert len(languages) == 252 == len(table) and {"hot", "long"} <= set(languages)


def test_markup(spark):
    cases = {
        "<p>Ab<script>no</script >cd<STYLE x>no</style>e &amp; f<!-- no --> g</p>": "ab cd e f g",
        "<script>open forever <b>x</b>": "open forever x",
        "<!-- open <i>y</i> z": "y z",
        "a < b": "a b",
        "": "",
    }
    assert {k: langid.visible(k).strip() for k in cases} == cases


def test_very_long_pages(spark):
    """Tags that never end, a megabyte of each: one pass, not one for each tag."""
    parts = ("<script>", "<style ", "<!--", "<", "<html ", "&amp", "<script></style>")
    began = time.time()
    for part in parts:
        langid.visible(part * (1_000_000 // len(part)))
    assert time.time() - began < 20
    docs, _, _ = tables(spark, random.Random(5))
    pages = spark.createDataFrame([(i, "http://a.fr/", p * (1_000_000 // len(p))) for i, p in enumerate(parts)], "page_id long, url string, html string")
    assert langid.identify(pages, docs).count() == len(parts)
