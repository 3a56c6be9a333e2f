"""Language identification, HTML extraction, BPE, token files and packing, on small tables."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandset.llm import bpe, html_text, langid, packing, tokens

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
BYTE_JSON, WORD_JSON = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ALPHABET = ["a", "b", "S", "t", "re", "ve", "ll", "d", "m", "'", "'", " ", "  ", "\n", "\t", "1", "½", "é", "ß", "Σ", "中", "!", "-", ",", ".", " ", "\x1c", "\x01", "́", "😀", "İ", "\r\n", "٣", "<|endoftext|>", "\x0b", "\xa0"]
FIELDS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def odd_texts(n, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(n)] + ["", " ", "a" * 500, "ab " * 3000, "x" * 60 + "'ll", "\n \n", "a \n b ", "foo.bar,,baz ."]


def documents(spark, texts, langs=None, ids=None):
    """The columns of documents, with one more whose name clashes with an operator's."""
    rows = [((ids or range(len(texts)))[i], t, (langs or ["en"] * len(texts))[i], "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, FIELDS).withColumn("key", F.lit(1))


def test_bpe_equals_the_library(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = odd_texts(3000)
    assert [x.tolist() for x in bpe.Encoder(RANKS).encode(texts)] == [library.encode_ordinary(x) for x in texts]
    df = documents(spark, [*texts[:50], None, "same", "same"])
    got = {r.doc_id: r for r in bpe.bpe_digests(df, RANKS).collect()}
    for i, text in enumerate([*texts[:50], "", "same", "same"]):
        ids = library.encode_ordinary(text)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.bpe_digests(df.limit(0), RANKS).count() == 0


def test_bpe_class_of_code_points():
    """By contractions, whose tokens tell letters and numbers from other code points."""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codes = [c for c in [*range(0x3200), *range(0xA700, 0xAC00), *range(0x10000, 0x12000), *range(0x16000, 0x17000), *range(0x1C000, 0x1F000)] if not 0xD800 <= c < 0xE000]
    texts = [f"{chr(c)}'s" for c in codes]
    assert [x.tolist() for x in bpe.Encoder(RANKS).encode(texts)] == [library.encode_ordinary(x) for x in texts]


def test_bpe_scan_is_associative():
    symbols = np.random.default_rng(1).integers(0, 9, 5000).astype(np.int32)
    product, _, generator, _ = bpe.monoid()
    want = generator[symbols].copy()
    for i in range(1, len(want)):
        want[i] = product[want[i - 1], want[i]]
    assert (bpe.scan(generator[symbols]) == want).all()


def test_bpe_table_round_trip(spark):
    coded = bpe.bpe_encode(documents(spark, ["hello wörld", None]), RANKS)
    rows = {r.doc_id: r for r in coded.collect()}
    assert rows[1].ids == [] and rows[0].offsets[0] == 0 and len(rows[0].offsets) == len(rows[0].ids)
    assert {r.doc_id: bytes(r.content) for r in bpe.bpe_decode(coded, RANKS).collect()} == {0: "hello wörld".encode(), 1: b""}


@pytest.mark.parametrize("path, by", [(BYTE_JSON, "bytes"), (WORD_JSON, "words")])
def test_library_tokenizer(path, by):
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    texts = odd_texts(4000, 9)
    assert [x.tolist() for x in tokens.LibraryTokenizer(path, by).encode(texts)] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_simple8b():
    rng = np.random.default_rng(0)
    for n in (0, 1, 59, 60, 61, 1023, 1024, 1025, 5000):
        for top in (0, 1, 100, 50257, 2**31, 2**60 - 1, 2**60, 2**64 - 1):
            values = rng.integers(0, top, n, np.uint64, endpoint=True)
            values[rng.random(n) < 0.7] %= np.uint64(9)
            words, starts = tokens.pack_words(values)
            assert (tokens.unpack_words(words, starts, n) == values).all()
    assert len(tokens.pack_words(np.zeros(600, np.uint64))[0]) == 10


def test_damaged_token_files_are_errors():
    good = tokens.write_segment([1, None], [np.array([5, 0]), np.array([0])], 3) + tokens.END.encode()
    assert [x[4].tolist() for x in tokens.read_segments(good * 2)] == [[5, 0, 0]] * 2
    for bad in (good[:-1], good[:30], b"x" + good[1:], good[:-20] + good[-19:]):
        with pytest.raises(ValueError):
            list(tokens.read_segments(bad))


def test_token_files(spark):
    texts = [*odd_texts(60), None, "same", "same"]
    ids = [3, 3, *range(100, 100 + len(texts) - 3), None]
    library = Tokenizer.from_file(BYTE_JSON)
    library.encode_special_tokens = True
    want = [[*library.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]
    rows = tokens.token_digests(documents(spark, texts, ids=ids).repartition(3), BYTE_JSON).collect()
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0))
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    assert sorted([(r.doc_id or -1, r.n_tokens, r.ids_crc32) for r in rows]) == sorted([(ids[i] or -1, len(want[i]), crc(want[i])) for i in order])
    spans = sorted((r.start, r.start + r.n_tokens) for r in rows)
    assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    ordered = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert ordered == [ids[i] for i in order]
    assert tokens.token_digests(documents(spark, texts).limit(0), BYTE_JSON).count() == 0


def test_packing(spark):
    texts = [*odd_texts(60), None, "word " * 7000, "same.", "same."]
    library = Tokenizer.from_file(WORD_JSON)
    library.encode_special_tokens = True
    want = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    rows = packing.pack_sequences(documents(spark, texts), WORD_JSON, with_ids=True).collect()
    held: dict = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == len(held.setdefault(r.doc_id, [])) and len(r.ids) == r.length and r.doc_tokens == len(want[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        held[r.doc_id] += r.ids
    assert held == want
    sequences: dict = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == sequences.get(r.sequence_id, 0)
        sequences[r.sequence_id] = r.offset + r.length
    assert max(sequences.values()) <= packing.SIZE
    assert packing.pack_sequences(documents(spark, texts).limit(0), WORD_JSON).count() == 0


def test_cuts_are_cheapest():
    """Against dynamic programming over all pairs of cuts."""
    rng = np.random.default_rng(4)
    final = np.array([False, True, False, False])
    for _ in range(30):
        ids = rng.integers(0, 4, rng.integers(1, 120))
        ends = np.unique(np.append(rng.integers(1, len(ids) + 1, 4), len(ids)))
        got = packing.cuts(ids, ends, final, size=32, grid=8, short=(4, 8, 16), short_cost=3)
        price = {0: 0}
        for j in range(1, len(ids) + 1):
            if j in ends or j == len(ids):
                price[j] = packing.COST[0]
            elif final[ids[j - 1]]:
                price[j] = packing.COST[1]
            elif j % 8 == 0:
                price[j] = packing.COST[2]
        cost = lambda n: min(32 - n, 3 if n in (4, 8, 16) else 32)
        best = {0: 0}
        for j in sorted(price)[1:]:
            best[j] = price[j] + min(best[i] + cost(j - i) for i in price if i < j and j - i <= 32)
        edges = [0, *got]
        assert sum(price[j] + cost(j - i) for i, j in zip(edges, got, strict=False)) == best[len(ids)]


def test_language_id(spark):
    words = {"en": "the of and this that with from water river stone", "de": "der die und das nicht mit wasser fluss stein über", "fr": "le la des une dans avec eau rivière pierre où"}
    rng = random.Random(1)
    texts, langs = [], []
    for i in range(300):
        lang = list(words)[i % 3]
        texts.append(" ".join(rng.choices(words[lang].split(), k=rng.randint(5, 40))))
        langs.append(lang)
    texts += [None, "", "123 ... !!", "The OF and", "a", f"{words['en']} " * 20000]
    langs += [None, "en", "de", None, "en", "en"]
    got = {r.doc_id: r for r in langid.language_predictions(documents(spark, texts, langs)).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in held) for i in range(300))
    assert np.mean([got[i].lang_pred == langs[i] for i in held]) > 0.95
    assert [(got[i].lang_pred, got[i].score) for i in (300, 301, 302)] == [("und", 0.0)] * 3
    assert got[303].lang_pred == "en" and got[305].lang_pred == "en" and all(0 <= r.score <= 1 for r in got.values())
    assert langid.language_predictions(documents(spark, texts, langs).limit(0)).count() == 0
    unlabelled = documents(spark, ["some text"]).withColumn("lang", F.lit(None).cast("string"))
    assert langid.language_predictions(unlabelled).first().lang_pred == "und"


def test_texts_like_no_language_go_by_one_rule_at_every_length(spark):
    rng = random.Random(3)
    english = "the of and this that with from water river stone house people town which when their there would other into".split()
    german = "der die und das nicht mit wasser fluss stein über haus leute stadt welche wenn dort andere würde ihre einer".split()
    learned = [(" ".join(rng.choices(w, k=60)), x) for w, x in ((english, "en"), (german, "de")) for _ in range(40)]
    profiles = langid.learn_profiles(documents(spark, *map(list, zip(*learned, strict=True))))
    vectors = langid.learn(documents(spark, *map(list, zip(*learned, strict=True))))
    for name, words in (("en", english), ("de", german)):
        grams, owner = langid.ngrams([t for t, x in learned if x == name])
        vector, size = profiles[name]
        assert size == len(grams) and (vector == vectors[name]).all() and (vector == langid.bundles(owner * 0, grams, 1)[0]).all()
    stay = [" ".join(rng.choices(w, k=k)) for w in (english, german) for k in (1, 2, 3, 5, 10, 30, 100, 20000)] + ["the river " * 500]
    gone = [None, "", "12 34 !"] + ["".join(rng.choices("бвгджзклмнпрст ", k=k)) for k in (200, 1000, 50000)] + ["".join(rng.choices("qxzjkvbpy ", k=400))]
    df = documents(spark, stay + gone)
    kept = langid.known_language(df, profiles)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == list(range(len(stay)))
    assert {r.doc_id for r in langid.known_language(df, {}).collect()} == set(range(len(stay) + len(gone))) - {len(stay), len(stay) + 1, len(stay) + 2}
    assert langid.known_language(df.limit(0), profiles).count() == 0
    twice = df.unionAll(df).selectExpr("cast(null as bigint) as doc_id", "text", "1 as at", "lang")
    assert langid.known_language(twice, profiles).count() == 2 * len(stay)


def test_ties_go_to_the_first_language_and_rows_repeat(spark):
    rows = [(1, "stone river", "b"), (1, "stone river", "b"), (2, "stone river", "a"), (2, "stone river", "a"), (None, "stone river", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = langid.classify(df, langid.learn(df)).collect()
    assert len(got) == 5 and {r.lang_pred for r in got} == {"a"} and all(abs(r.score - 1) < 1e-9 for r in got)
    assert [r.held_out for r in langid.language_predictions(df).where("doc_id is null").collect()] == [zlib.crc32(b"") % 5 == 0]


def test_ngram_bundles_equal_the_definition():
    texts = ["Ab ça", "x", "--", "a b"]
    grams, owner = langid.ngrams(texts)
    got = langid.bundles(owner, grams, len(texts))
    for i, text in enumerate(["\0ab\0ça\0", "\0x\0", "", "\0a\0b\0"]):
        want = np.zeros(langid.DIMENSIONS)
        for j in range(len(text) - 2):
            a, b, c = (langid.letter(ord(ch)).astype(int) for ch in text[j : j + 3])
            want += np.roll(a, 2) * np.roll(b, 1) * c
        assert (got[i] == want).all()
    unique, inverse = langid.distinct(grams)
    assert (unique[inverse] == grams).all() and len(set(unique.tolist())) == len(unique)


LONG = "The water of the river is cold and it was for the people that they came with their boats to the town. " * 3


def test_html_blocks():
    page = f"""<!doctype html><html><head><title>t</title><script>if (a < b) "</p>"</script></head><body>
    <header class="site">Site name</header><nav><a href=x>Home</a> <a href=y>News</a></nav>
    <div class="cookie-notice">{LONG}</div>
    <article><h1>Title &amp; more</h1><p>{LONG}<p>Second&nbsp;one <b>bold</b><br>line <img src=x alt="no">
    <div class="ad">{LONG}</div><form><label>Name</label><input></form><!-- {LONG} --><blockquote>A quote &#8211; short.</blockquote>
    <section class="comments"><p>{LONG}</p></section></article>
    <aside>{LONG}</aside><footer>&copy; footer</footer></body></html>"""
    assert html_text.extract(page).split("\n") == ["Title & more", " ".join(LONG.split()), "Second one bold line", "A quote – short."]


def test_html_without_article():
    page = f"<body><div><h2>Head</h2><p>{LONG}</p><p>{LONG}</p><p>Short end.</p></div><div><ul><li><a href=a>{LONG}</a></li><li><a href=b>two</a></li></ul></div><p>{'zzz ' * 60}</p>"
    assert html_text.extract(page).split("\n") == ["Head", " ".join(LONG.split()), " ".join(LONG.split()), "Short end."]


def test_html_oddities(spark):
    rows = [(1, "u", None, 0), (2, None, "", 0), (3, "u", "<p", 0), (4, "u", '<a href="x>never closed <p>y', 0), (5, "u", "a < b & c", 0), (5, "u", "a < b & c", 0), (None, None, "<article>" + "<div>" * 3000 + "deep", 0), (7, "u", "<script>open", 0), (8, "u", f"<article><p>{LONG * 400}", 0)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")
    got = html_text.extract_text(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = [(r.page_id, r.text, r.n_chars) for r in got.collect()]
    assert len(found) == len(rows) and all(n == len(t) for _, t, n in found)
    by = dict((k, t) for k, t, _ in found)
    assert by[1] == by[2] == by[7] == "" and by[None] == "deep" and len(by[8]) > 300 * 400
    assert html_text.extract_text(df.limit(0)).count() == 0


def test_added_tokens_as_the_library_takes_them(spark):
    texts = [*odd_texts(300, 4), "hi <|endoftext|> there", "<|startoftext|><|endoftext|>", "<|ENDOFTEXT|> a", "x<|endoftext|>, y" * 3, "none"]
    for path, by in ((BYTE_JSON, "bytes"), (WORD_JSON, "words")):
        library = Tokenizer.from_file(path)
        assert [x.tolist() for x in tokens.LibraryTokenizer(path, by, added=True).encode(texts)] == [library.encode(x, add_special_tokens=False).ids for x in texts]
    library = Tokenizer.from_file(BYTE_JSON)
    rows = {r.doc_id: r for r in tokens.token_digests(documents(spark, texts), BYTE_JSON, added=True).collect()}
    for i, text in enumerate(texts):
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        assert (rows[i].n_tokens, rows[i].ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_blocks_of_a_file():
    values = np.zeros(600, np.uint64)
    words, starts = tokens.pack_words(values, 256)
    assert len(words) == 12 and starts.tolist() == [0, 5, 10, 12]
    assert (tokens.unpack_words(words, starts, 600, 256) == values).all()
