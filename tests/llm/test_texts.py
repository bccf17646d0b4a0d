"""Tokens, chats, URLs, classifiers and the pipeline."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexmere.llm import bpe, chat, labelled, quality, queries, tokencount, toxicity, urlfilter

SF, SF2, SF3 = "/root/testdata/sf0.001", "/root/testdata/sf0.01", "/root/testdata/sf0.1"
PATH = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def theirs():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def same(theirs, text):
    ids = theirs.encode(text, add_special_tokens=False).ids
    return bpe.encode(PATH, text) == ids and bpe.decode(PATH, ids) == theirs.decode(ids, skip_special_tokens=False)


PARTS = ["a", "b", " ", "\n", "'s", "'", "'ll", "1", "23", "e\u0301", "é", "ΑΣ", "Σ", "İ", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "!!", "日本", "\u00a0", "\u3000", "\x1c", "\x85", "\u1100\u1161", "th", "ing", "\U0001f600", "ß", "ﬁ", "\u200b", "²", "a" * 70, "!" * 80]


def test_bpe_is_the_tokenizers(theirs):
    r = random.Random(1)
    assert all(same(theirs, "".join(r.choice(PARTS) for _ in range(r.randint(0, 25)))) for _ in range(1500))


@pytest.mark.parametrize("segment,chunk,long", [(7, 16, 5), (50, 64, 20)])
def test_bpe_streams_with_small_buffers(theirs, monkeypatch, segment, chunk, long):
    for name, value in (("SEGMENT", segment), ("CHUNK", chunk), ("LONG", long)):
        monkeypatch.setattr(bpe, name, value)
    bpe._loaded.cache_clear()
    r = random.Random(2)
    for _ in range(60):
        letters = "".join(r.choice(["th", "e", "ing", "tion", "in", "er", "a", "é"]) for _ in range(r.randint(1, 1500)))
        assert same(theirs, letters) and same(theirs, "".join(r.choice("!?.,-=") for _ in range(r.randint(1, 900)))) and same(theirs, "".join(r.choice(PARTS) for _ in range(200)))
    bpe._loaded.cache_clear()


def test_long_words_keep_a_bounded_buffer():
    m = bpe._loaded(PATH)[0]
    state, most = bpe.LongWord(m), 0
    for _ in range(40):
        for _ in state.feed("thisisaverylongword" * 60):
            pass
        most = max(most, len(state.data))
    assert m.lookahead < 400 and most <= m.lookahead + 1 + 2 * bpe.CHUNK


def test_decoder_gives_text_back_byte_by_byte():
    d = bpe.Decoder(bpe._loaded(PATH)[0], surface=False)
    ids = bpe.encode(PATH, "naïve 日本 \U0001f600 ok")
    assert "".join(d.feed([i]) for i in ids) + d.end() == "naïve 日本 \U0001f600 ok "


def test_bpe_query(spark, theirs):
    for r in queries.op2_bpe(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").collect():
        ids = theirs.encode(r.text, add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(theirs.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_odd_rows(spark, theirs):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "x" * 200_000), (3, "x" * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("t", F.lit(1)).withColumn("n_tokens", F.lit("?"))
    got = sorted((-1 if r.id is None else r.id, r.n_tokens) for r in bpe.token_digests(df, PATH).collect())
    n = len(theirs.encode("x" * 200_000, add_special_tokens=False).ids)
    assert got == [(-1, 2), (1, 0), (2, 0), (3, n), (3, n)]
    assert bpe.token_digests(df.limit(0), PATH).count() == 0


# --- token counts


def test_attribution_rules():
    enc, size = tokencount.encoding(RANKS, public_tokenizers.PATTERN)
    r = random.Random(3)
    for _ in range(300):
        data = "".join(r.choice(["a", "é", "\n", "\n\n", " the", "日本", " \n", "x\ny"]) for _ in range(r.randint(1, 12))).encode()
        ends = np.cumsum(size[enc.encode_ordinary(data.decode())])
        begin, end = tokencount.lines(np.frombuffer(data, np.uint8))
        for rule in tokencount.RULES:
            want, at = [0] * len(begin), 0
            for x in ends.tolist():
                over = [max(0, min(x, hi) - max(at, lo)) for lo, hi in zip(begin.tolist(), end.tolist())]
                of = [i for i, o in enumerate(over) if o]
                want[of[0] if rule == "first" else of[-1] if rule == "last" else max(of, key=lambda i: (over[i], -i))] += 1
                at = x
            assert tokencount.attribute(ends, begin, end, rule)[0].tolist() == want


def test_token_counts_query(spark):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    enc = tokencount.encoding(RANKS, public_tokenizers.PATTERN)[0]
    assert isinstance(enc, tiktoken.Encoding)
    total = {}
    for r in queries.op10_token_counts(spark, SF).collect():
        assert text[r.doc_id][r.begin : r.end].removesuffix("\n") == text[r.doc_id].split("\n")[r.section]
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
    assert total == {i: len(enc.encode_ordinary(t)) for i, t in text.items()}


def test_token_counts_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "a\n", None), (3, "a\nb " * 30_000, "c"), (3, "x", "d")], "doc_id long, text string, section string")
    got = tokencount.section_counts(df, RANKS, public_tokenizers.PATTERN)
    assert got.where("id in (1, 2) or id is null").groupBy("id").agg(F.sum("n_tokens")).count() == 3
    assert got.where("id = 3").count() == 30_002
    assert tokencount.section_counts(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0
    with pytest.raises(ValueError):
        tokencount.section_counts(df, RANKS, public_tokenizers.PATTERN, "any")
    f = {(r.id, r.field): r.n_tokens for r in tokencount.field_counts(df, RANKS, public_tokenizers.PATTERN, ["section", "text"]).where("id in (1, 2)").collect()}
    assert f == {(1, "section"): 2, (1, "text"): 0, (2, "section"): 2, (2, "text"): 0}


# --- chat


def test_chat_reads_back():
    r = random.Random(0)
    for _ in range(2000):
        text = "".join(r.choice(["[", "<", "\\", "]", " ", "</s>", "[/INST]", " [/INST]", "a", "\n", "é", "\\["]) for _ in range(r.randint(0, 9)))
        for role in ("user", "assistant", "system", "tool", "[ROLE] ", "", None):
            parts = chat.segments(role, text)
            assert chat.read_turn("".join(t for t, _ in parts)) == (role or "", text)
            assert [chat.unescaped(t) for t, loss in parts if loss] == ([text] if role == "assistant" else [])


def test_chat_query(spark):
    turns = {}
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    for c, _, role, text in sorted(rows + [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]):
        turns.setdefault(c, []).append((role, text))
    got = {r.conv_id: r for r in queries.op6_chat(spark, SF).collect()}
    assert got.keys() == turns.keys()
    for c, of in turns.items():
        loss = "".join(t for role, t in of if role == "assistant")
        assert got[c].n_turns == len(of) and got[c].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in of).encode()).hexdigest()
        assert got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and got[c].in_order
        assert got[c].formatted_chars == 3 + sum(len(t) for a, b in of for t, _ in chat.segments(a, b))


def test_chat_odd_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (2, 0, "assistant", "x"), (2, 0, "assistant", "x"), (None, 0, None, "q"), (3, None, "user", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("conv", F.lit("c"))
    got = {r.conv: (r.n_turns, r.in_order, r.complete, r.loss_chars) for r in chat.format_conversations(df).collect()}
    assert got == {1: (2, True, True, 1), 2: (2, False, True, 2), None: (1, False, False, 0), 3: (1, True, False, 0)}
    assert chat.format_conversations(df.limit(0)).count() == 0


# --- URLs


def test_url_parts_and_tokens():
    for url, want in {"http://WWW.Example.com/en/1?x#y": ("www.example.com", "/en/1"), "a.com/x": ("", ""), None: ("", ""), "http://a.com?x=/en/": ("a.com", ""), "x://a#b/c": ("a", ""), "": ("", ""), "http://É.com/é": ("É.com", "/é")}.items():
        assert urlfilter.parts(url) == want
    assert urlfilter.site_tokens("a.com/en") == {"a", "com"} and urlfilter.pattern_tokens("^cheap^pills*x^") == {"cheap"}


def judge_plain(url, sites):
    host, path = urlfilter.parts(url)
    fits = [r for r in sites if host and (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    if fits:
        rule = max(fits, key=len)
        return host, path, rule, sites[rule]
    return host, path, None, "block" if any(urlfilter.pattern_expression(p).search(host + path) for p in urlfilter.PATTERNS) and host else "allow"


def test_url_rules_as_without_an_index(spark):
    r = random.Random(6)
    urls = ["http://" + r.choice(["", "www.", "a.", "not"]) + r.choice(["example.com", "example.net", "com", "net", "casino-x.org", "xcasino.org", "spam-farm.net"]) + r.choice(["", "/", "/en/", "/en", "/es/1", "/fr/?q", "/EN/"]) for _ in range(400)] + [None, "", "x", "http://", "://com/"] + ["http://a.com/" + "y" * 100_000]
    df = spark.createDataFrame([(u,) for u in urls], "url string").withColumn("rule", F.lit("old")).withColumn("page_id", F.lit(1))
    got = urlfilter.judge(df, queries.SITES)
    assert got.columns[:3] == ["url", "rule", "page_id"]
    assert sorted(map(repr, ((x.url, x.host, x.path, x.rule, x.verdict) for x in got.collect()))) == sorted(repr((u, *judge_plain(u, queries.SITES))) for u in urls)
    assert urlfilter.judge(df.limit(0), queries.SITES).count() == 0


# --- classifiers


def auc(score, y):
    order = np.sort(score[y == 0])
    return (np.searchsorted(order, score[y == 1], "left") + np.searchsorted(order, score[y == 1], "right")).mean() / 2 / len(order)


@pytest.mark.parametrize("name,label,least", [("op7_quality", "quality", 0.99), ("op8_toxicity", "toxic", 0.97)])
def test_held_out_accuracy(spark, name, label, least):
    rows = getattr(queries, name)(spark, SF3).join(spark.read.parquet(f"{SF3}/labels.parquet"), "doc_id").where("held_out").collect()
    y, s = np.array([r[label] for r in rows]), np.array([r.score for r in rows])
    p = np.array([r.predicted for r in rows])
    assert auc(s, y) >= least and np.mean(p == y) >= 0.97
    if label == "toxic":
        assert p[y == 1].mean() >= 0.9 and 1 - p[y == 0].mean() >= 0.98


def test_labels_are_not_learned_from_held_out_rows(spark):
    docs = spark.range(400).selectExpr("id doc_id", "concat('text ', id) text")
    texts, y = labelled.sample(docs, docs.selectExpr("doc_id", "1 quality"), "quality")
    ids = {int(t.split()[1]) for t in texts}
    assert ids == {i for i in range(400) if not labelled.held_out_id(i)} and len(y) == len(ids)
    assert len(labelled.sample(docs, docs.selectExpr("doc_id", "1 quality"), "quality", rows=7)[0]) == 7


@pytest.mark.parametrize("module,label", [(quality, "quality"), (toxicity, "toxic")])
def test_classifier_odd_rows(spark, module, label):
    rows = [(1, None), (2, ""), (None, "a"), (3, "b " * 90_000), (3, "b"), (4, "\n"), (5, "é" * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("?")).withColumn("t", F.lit(0))
    for labels in ([], [(1, 1), (2, 0), (3, 1), (5, 0), (9, None)]):
        model = module.fit(df, spark.createDataFrame(labels, f"doc_id long, {label} int"))
        got = module.scores(df, model).collect()
        assert len(got) == 7 and all(0 <= r.score <= 1 for r in got)
    assert module.scores(df.limit(0), model).count() == 0


def test_altered_insults_are_caught(spark):
    docs, labels = (spark.read.parquet(f"{SF3}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    rows = docs.join(labels, "doc_id").where((labelled.held_out(F.col("doc_id"))) & (F.col("toxic") == 0) & F.length("text").between(300, 3000)).orderBy("doc_id").limit(100).collect()
    rng, words = random.Random(5), [w for w in model.landmarks[:8] if w.isalpha()]

    def caught(how, times):
        texts = []
        for r in rows:
            w = r.text.split()
            for _ in range(times):
                w.insert(rng.randrange(len(w) + 1), how(rng.choice(words)))
            texts.append(" ".join(w))
        return np.mean(toxicity.score_texts(model.word_scorer(), texts) >= 0.3)

    sign = lambda w: w[:2] + rng.choice("*.-_") + w[2:]
    assert caught(lambda w: w, 1) >= 0.9
    assert caught(sign, 3) >= 0.8 and caught(sign, 1) >= 0.8 and caught(".".join, 1) >= 0.8 and caught(" ".join, 1) >= 0.8
    assert caught(lambda w: w, 0) <= 0.02

    def put(w):
        i = rng.randrange(1, len(w))
        return w[:i] + rng.choice("aeioubcdtx") + w[i:]

    found = caught(put, 1), caught(put, 3), caught(lambda w: (i := rng.randrange(1, len(w))) and w[:i] + w[i - 1] + w[i:], 1)
    assert found[0] >= 0.4 and found[1] >= 0.8 and found[2] >= 0.4, found


def test_kernel_is_the_gapped_subsequence_kernel():
    def plain(a, b):
        def phi(w):
            w, out = "^" + w, {}
            for i in range(len(w)):
                for off in toxicity._OFFSETS:
                    if i + off[-1] < len(w):
                        key = "".join(w[i + o] for o in off)
                        out[key] = out.get(key, 0) + toxicity.DECAY ** (off[-1] + 1)
            return out

        x, y = phi(a), phi(b)
        dot = lambda p, q: sum(v * q.get(k, 0) for k, v in p.items())
        return (dot(x, y) / np.sqrt(dot(x, x) * dot(y, y))) ** toxicity.POWER

    words = ["idiot", "id*iot", "loser", "losser", "papapa"]
    got = toxicity.Kernel(words)(words)
    assert np.allclose(got, [[plain(a, b) for b in words] for a in words], atol=1e-3)


def test_convolution_is_the_plain_one():
    net = quality.Net()
    s, t = quality.Scorer(net), net.tables()
    text = bytes(random.Random(1).randbytes(700))
    conv = np.array([sum(t[k][(text + b"\0" * 8)[i + k]] for k in range(quality.WIDTH)) for i in range(len(text))])
    half = [conv[i : i + quality.HALF].max(0) for i in range(0, len(text), quality.HALF)]
    chunk = np.maximum(np.array([np.maximum(a, b) for a, b in zip(half, half[1:])]), 0)
    assert np.allclose(s.features([b"x", text])[1], np.concatenate([chunk.mean(0), chunk.max(0)]), atol=1e-4)


@pytest.mark.parametrize("toxic", [[], [0], [1]])
def test_nothing_is_dropped_without_labels_of_both_kinds(spark, tmp_path, toxic):
    import corpus_pipeline

    docs = spark.createDataFrame([(i, f"some plain text number {i}") for i in range(20)], "doc_id long, text string")
    spark.createDataFrame([(i, 1, y) for i in range(20) for y in toxic], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).count() == 20


def test_sample_is_full_where_labels_cover_far_more_documents(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(3000, 3040)], "doc_id long, text string")
    labels = spark.range(4000).selectExpr("id doc_id", "cast(id % 2 as int) toxic")
    want = sum(not labelled.held_out_id(i) for i in range(3000, 3040))
    assert len(labelled.sample(docs, labels, "toxic", rows=40)[0]) == want


# --- pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF2}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        from lexmere.session import stored

        docs = stored(stage(spark, docs, SF2))
        kept.append(docs.count())
        assert docs.columns == columns, name
    assert 1000 > kept[0] > 800 and kept == sorted(kept, reverse=True)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF2)
    assert last.count() == kept[-1] and docs.where("length(text) <> n_chars").count() == 0
    assert docs.groupBy("text").count().where("count > 1").count() == 0
