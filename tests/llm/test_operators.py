"""Edge cases and brute-force versions of the corpus operators."""

import base64
import collections
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quillgrid.llm import decontaminate, fingerprints, html, language, mixing, nearjoin, quality, substrings, tokens, warc
from quillgrid.llm.queries import queries, tokenizer_path

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, r int, guest string, key string, size long, band string, anchor string, row_key string, start string, n int"


def text_of(rng, n):
    return " ".join(rng.choice(["the", "and", "river", "stone", "lamp", "green", "winter", "paper", "ago", "of"]) + rng.choice(["", "s", "ly", "er"]) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    a, b, c = text_of(rng, 60), text_of(rng, 300), text_of(rng, 200)
    texts = [(1, a), (2, a), (3, None), (4, ""), (5, "   \n "), (6, b), (7, b + " plus"), (8, "é" * 3 + " ŝ " + c), (9, "one two"), (9, "one two"), (9, "other text here"), (10, "x" * 200_000), (None, a), (11, c + c), (12, "word")]
    rows = [(i, t, ["en", "de", None][k % 3], ["s", "t", None, ""][k % 4], None if t is None else len(t), 1, "g", "k", 5, "b", "a", "rk", "st", 3) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ordered(df):
    return sorted(((r["doc_id"], r["text"] or "") for r in df.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode()))


def test_token_files(spark, docs, empty, tmp_path):
    out = f"file://{tmp_path}/tokens"
    manifest = tokens.write_tokens(docs, out, tokenizer_path(), length=64, parts=3)
    got = {(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokens.read_tokens(spark, out).collect()}
    from tokenizers import Tokenizer

    tok, start, want = Tokenizer.from_file(tokenizer_path()), 0, set()
    for i, t in ordered(docs):
        ids = [*tok.encode(t, add_special_tokens=False).ids, 2]
        want.add((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want and manifest["n_tokens"] == start
    reader = tokens.open_sequences(f"{out}/{manifest['files'][0]['name']}")
    ids, mask = tokens.sequence(reader, 0, 64)
    assert len(ids) == len(mask) == 64 and mask[0]
    assert tokens.token_output(empty, tokenizer_path()).count() == 0


def test_fingerprints(docs, empty):
    rows = fingerprints.fingerprint(docs, parts=3).collect()
    every = ordered(docs)
    want = collections.Counter((i, len(t), hashlib.sha256(fingerprints.edited_text(t, every[(k + 1) % len(every)][1]).encode()).hexdigest()) for k, (i, t) in enumerate(every))
    assert collections.Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows) == want
    assert len({r["fingerprint"] for r in rows if r["doc_id"] in (1, 2, None)}) == 1
    assert all(0 <= r[c] <= 1 for r in rows for c in ("near_edited", "near_next"))
    assert fingerprints.fingerprint(empty).count() == 0


def test_collision_rate_is_generalised_jaccard():
    rng, s, off = np.random.default_rng(0), fingerprints.Sampler(64), []
    for _ in range(60):
        h = rng.integers(0, 1 << 63, 300).astype(np.uint64)
        a, b = rng.choice([0, 0.25, 1, 3], 300), rng.choice([0, 0.25, 1, 3], 300)
        b = np.where(rng.random(300) < 0.6, a, b)
        one, two = (s.two([(h[w > 0], np.log(w[w > 0]), 0, int((w > 0).sum()))])[0] for w in (a, b))
        off.append(fingerprints.likeness(one, two) - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(off)) < 0.03


def test_language(spark, docs, empty):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.learn(d.where("doc_id % 4 <> 2"))
    got = language.predict(d.where("doc_id % 4 = 2"), model, ["lang"]).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(got)
    odd = {(r["doc_id"], r["lang_pred"]) for r in language.predict(docs, model, ["doc_id"]).collect()}
    assert {(3, "und"), (4, "und"), (5, "und")} <= odd
    none = language.learn(empty)
    assert {r["lang_pred"] for r in language.predict(docs, none, ["doc_id"]).collect()} == {"und"}
    assert language.predict(empty, model, ["doc_id"]).count() == 0


def test_language_sample_has_texts_once(spark, monkeypatch):
    """Languages whose rows are all one text are learned, and copies take one place."""
    seen = []
    monkeypatch.setattr(language.Model, "fit", lambda self, rows: seen.extend(rows))
    rng = random.Random(12)
    rows = [*((text_of(rng, 20) + f" {k}", "en") for k in range(300)), *[("the same text again", "en")] * 400, *((f"parole {chr(97 + k) * 3} mots", f"l{k}") for k in range(8) for _ in range(400))]
    model = language.learn(spark.createDataFrame(rows, "text string, lang string"), per_lang=40)
    count = collections.Counter(model.langs[y] for y, _, _ in seen)
    assert model.langs == ["en", *(f"l{k}" for k in range(8))] and count.pop("en") == 40 and set(count.values()) == {1}
    assert len({(y, at.tobytes(), tf.tobytes()) for y, at, tf in seen}) >= len(seen) - 1


def test_language_against_brute_force(spark, docs):
    """Chances from n-grams counted one by one, weighed by TF-IDF, and the model's weights."""
    import math

    d = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.learn(d.where("doc_id % 4 <> 2"), per_lang=30)
    df = collections.Counter(at for r in d.where("doc_id % 4 <> 2").collect() if (f := language.features(r["text"])) for at in f[0].tolist())
    n = d.where("doc_id % 4 <> 2").count()
    rows = docs.union(d.selectExpr("doc_id + 1000", "text", "lang", *[f"CAST(NULL AS {k}) AS {c}" for c, k in docs.dtypes[3:]])).collect()
    frame = spark.createDataFrame(rows, docs.schema)
    got = collections.Counter((r["text"], r["lang_pred"], round(r["score"], 4)) for r in language.predict(frame, model, ["text"]).collect())
    want = collections.Counter()
    for r in rows:
        f = language.features(r["text"]) if r["text"] else None
        if f is None:
            want[r["text"], "und", 0.0] += 1
            continue
        x = {at: tf * (math.log((1 + n) / (1 + df[at])) + 1) for at, tf in zip(*map(list, f), strict=True)}
        size = math.sqrt(sum(v * v for v in x.values()))
        z = [sum(v / size * float(model.w[at][k]) for at, v in x.items()) / model.t for k in range(len(model.langs))]
        p = [math.exp(v - max(z)) for v in z]
        want[r["text"], model.langs[p.index(max(p))], round(max(p) / sum(p), 4)] += 1
    assert sum((got - want).values()) <= 0.02 * len(rows)  # of scores that rounding parts
    assert {(t, y) for t, y, _ in got} == {(t, y) for t, y, _ in want}


def brute_labels(blocks):
    """The two passes, block by block, from their description."""
    share = lambda ws: sum(w in s for w in ws) / len(ws) if ws else 0.0
    words = [[w for w in html.re.findall(r"\w+", b["text"].lower())] for b in blocks]
    s = frozenset()
    pool = [w for b, ws in zip(blocks, words, strict=True) if b["where"] in ("", "main") for w in ws]
    best = -1.0
    for stop in html.STOP_SETS.values():
        s, kept = stop, s
        if share(pool) > best:
            best = share(pool)
        else:
            s = kept
    first = []
    for b, ws in zip(blocks, words, strict=True):
        inside, n, link = b["where"] == "main", len(b["text"]), b["linked"] / len(b["text"])
        head = b["tag"] in {f"h{k}" for k in range(1, 7)}
        if b["where"] not in ("", "main") or (link > 0.33 and not (inside and head)) or ("©" in b["text"][:200] and not (inside and n >= 200)):
            first.append(False)
        elif link <= 0.33 and ((n >= 70 and share(ws) >= (0.12 if inside else 0.2)) or (n >= 200 and (share(ws) >= 0.12 or link == 0))):
            first.append(True)
        else:
            first.append(None)
    total = lambda where, keep: sum(len(b["text"]) for b, x in zip(blocks, first, strict=True) if (b["where"] == "main") == where and keep(x))
    if total(True, lambda x: x is not False) > total(False, lambda x: x is True):
        first = [x if b["where"] == "main" else bool(x) and len(b["text"]) >= 200 and share(ws) >= 0.2 and b["linked"] == 0 for b, ws, x in zip(blocks, words, first, strict=True)]
    out = []
    for k, (b, x) in enumerate(zip(blocks, first, strict=True)):
        if x is None:
            near = [(abs(j - k), j > k, y) for j, (o, y) in enumerate(zip(blocks, first, strict=True)) if y is not None and (o["where"] == "main" or b["where"] != "main")]
            before = min((t for t in near if not t[1]), default=(0, 0, None))[2]
            after = min((t for t in near if t[1]), default=(0, 0, None))[2]
            if b["tag"] in {f"h{j}" for j in range(1, 7)} and after is not None:
                x = after
            elif before is None and after is None:
                x = True
            else:
                x = bool((before and after) or ((before or after) and b["linked"] == 0))
        out.append(x)
    return out


def test_passes_against_brute_force():
    import duckdb

    rng = random.Random(23)
    pages = [t for (t,) in duckdb.sql(f"SELECT html FROM '{SF}/pages.parquet'").fetchall()]
    lots = [html.blocks_of(p) for p in pages] + [html.blocks_of(p.replace("article", "div").replace("main", "div")) for p in pages]
    for _ in range(400):
        lots.append([{"text": text_of(rng, rng.choice([1, 3, 10, 30, 60])), "where": rng.choice(["", "", "main", "bad"]), "tag": rng.choice(["p", "p", "h2", "li"]), "linked": 0} for _ in range(rng.randint(1, 12))])
        for b in lots[-1]:
            b["linked"] = rng.choice([0, 0, len(b["text"]) // 2, len(b["text"]) // 5])
    assert all(html.labels_of(b) == brute_labels(b) for b in lots)
    assert html.main_text("<article><div class='article-header'><h1>Title</h1></div><p>Body text.</p></article>") == "Title\nBody text."
    assert html.main_text("<article><section class='legal'><p>Law here.</p></section></article>") == "Law here."


def test_decontaminate(spark, docs, empty):
    rng = random.Random(5)
    item = "Which stone did the green lamp hide under winter paper by the river? It hid the seventh quiet amber pebble of Orlan."
    clean = [text_of(rng, 400) for _ in range(3)]
    d = spark.createDataFrame([(1, clean[0] + " " + item.upper() + "\n" + clean[1]), (2, clean[2]), (3, None), (4, ""), (5, item)], "doc_id long, text string")
    items = spark.createDataFrame([(7, item, 1.0), (8, text_of(rng, 40) + " zebra quartz violin", 1.0), (9, None, 0.0), (10, "", 0.0), (7, item, 1.0)], "item_id long, text string, score double")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(d, items).collect()} == {(1, 7), (5, 7)}
    assert {r["doc_id"] for r in decontaminate.remove_leaks(d, items).collect()} == {2, 3, 4}
    assert decontaminate.find_leaks(empty, items).count() == 0
    assert decontaminate.find_leaks(d, items.limit(0)).count() == 0
    assert decontaminate.remove_leaks(docs, items).columns == docs.columns


def test_item_weights_do_not_depend_on_slices(spark, monkeypatch):
    rng = random.Random(6)
    texts = [text_of(rng, 30) + f" zebra{k % 4} quartz{k}" for k in range(10)]
    d = spark.createDataFrame([(k, "One more. " + t.replace("quartz", "x")) for k, t in enumerate(texts)], "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    score = lambda groups: {(index.ids[i], t): round(float(index.share[index.first[k]: index.first[k + 1]][j]), 6) for g in groups for index in g for t, k in index.vocab.items() for j, i in enumerate(index.item[index.first[k]: index.first[k + 1]])}
    want = {r["doc_id"]: r["score"] for r in decontaminate.find_leaks(d, items).collect() if r["doc_id"] == r["item_id"]}
    assert len(want) == 10 and score(decontaminate.indexes(items)) == score([[decontaminate.Index(list(enumerate(texts)))]])
    monkeypatch.setattr(decontaminate, "ITEMS", 3)
    assert {r["doc_id"]: r["score"] for r in decontaminate.find_leaks(d, items).collect() if r["doc_id"] == r["item_id"]} == pytest.approx(want)
    assert score(decontaminate.indexes(items, 500)) == score([[decontaminate.Index(list(enumerate(texts)))]])
    long = items.union(spark.createDataFrame([(99, text_of(rng, 700))], "item_id long, text string"))  # has windows of its own
    assert {r["doc_id"] for r in decontaminate.find_leaks(d, long).collect()} == set(range(10))
    assert [(len(i.ids), i.size) for g in decontaminate.indexes(long, 1 << 20) for i in g] == [(3, 64)] * 3 + [(1, 64), (1, 1024)]


def test_short_answers(spark):
    """An item whose last sentence is a word or two is found without its last word."""
    question = "Which stone did the green lamp hide under the winter paper by the quiet river?"
    items = spark.createDataFrame([(1, question + " Amber."), (2, question.replace("?", ".") + " Take it. Er."), (3, "Seven green lamps hide under one winter river stone")], "item_id long, text string")
    texts = [question, question + " Take it", "Seven green lamps hide under one winter river", "Which stone is green?"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(d, items).collect()} == {(0, 1), (1, 1), (1, 2), (2, 3)}
    for text in ("", "a", "a b c d e f", "a b c d e f g", "A. B. C. D.", "a b c d e f. g h.", "a b c d. e f g h i."):
        q, a = decontaminate.question_answer(text)
        assert q + a == decontaminate.words(text)


def test_block_bounds_lose_nothing(spark):
    """Every item that plain BM25 over the same windows finds is found."""
    import duckdb

    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    texts = [t for (t,) in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet'").fetchall()]
    index = decontaminate.Index(items)
    weight = np.zeros((len(index.vocab), len(items)))
    for k in range(len(index.vocab)):
        weight[k, index.item[index.first[k] : index.first[k + 1]]] = index.share[index.first[k] : index.first[k + 1]]
    assert np.allclose(weight.sum(0), 1) and (index.top == weight.max(1)).all()
    for t in texts:
        w, size, want = decontaminate.words(t), index.size, set()
        for a in range(0, max(1, len(w) - size), size):
            terms = sorted({index.vocab[x] for x in w[a : a + 2 * size] if x in index.vocab})
            want |= {(int(i), a) for i in np.flatnonzero(weight[terms].sum(0) >= 0.3 - 1e-5)}
        assert {(i, a) for i, a, _, _ in index.candidates(w, 0.3)} == want


def test_leaks_against_brute_force(spark):
    """BM25 shares of all windows and items, and run shares of question and answer, worked out one by one."""
    import math

    rng, W = random.Random(21), decontaminate.words
    items = [(k, text_of(rng, rng.choice([4, 20, 50, 90])) + f". Answer {k} is " + text_of(rng, 6)) for k in range(12)]
    texts = [text_of(rng, 150) + " " + " ".join(x for x in items[k % 12][1].split() if rng.random() > 0.1 * (k // 12)) + " " + text_of(rng, 90) for k in range(48)]
    n = len(items)
    df = collections.Counter(w for _, t in items for w in set(W(t)))
    mean = sum(len(W(t)) for _, t in items) / n
    runs = lambda w: {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
    want = {}
    for d, text in enumerate(texts):
        w = W(text)
        for i, t in items:
            own = collections.Counter(W(t))
            weight = {x: math.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(W(t)) / mean)) for x, f in own.items()}
            size = 64 if len(W(t)) <= 64 else 128
            for a in range(0, max(1, len(w) - size), size):
                window = w[a : a + 2 * size]
                score = sum(weight[x] for x in set(window) & set(own)) / sum(weight.values())
                shares = [len(runs(p) & runs(window)) / len(runs(p)) for p in decontaminate.question_answer(t)]
                if score >= 0.6 and min(shares) >= 0.5:
                    want[d, i] = max(want.get((d, i), (0,)), (score, *shares))
    got = {(r["doc_id"], r["item_id"]): tuple(r)[2:] for r in decontaminate.find_leaks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(want) > 20 and set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)


def test_warc(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/ü x", "<p>a</p>", 1), (2, None, "<p>a</p>", 1), (5, "http://b", None, 1), (4, "http://c", "", 1), (3, "http://d\r\nX: y", "<p>é</p>", 1), (None, "u", "<p>a</p>", 1)], "page_id long, url string, html string, top int")
    out = f"file://{tmp_path}/warc"
    manifest = warc.write_warc(pages, out, roll_bytes=400, parts=2)
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_warc(spark, out).collect()}
    digest = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    a, e = digest(b"<p>a</p>"), digest(b"")
    assert got == {1: (8, a, "revisit", 2), 2: (8, a, "response", None), None: (8, a, "revisit", 2), 5: (0, e, "response", None), 4: (0, e, "revisit", 5), 3: (9, digest("<p>é</p>".encode()), "response", None)}
    again = warc.write_warc(pages, f"file://{tmp_path}/again", roll_bytes=400, parts=2)
    assert again == manifest and len(manifest["files"]) > 1
    assert warc.warc_round_trip(pages.limit(0)).count() == 0


def test_mix(docs, empty, spark):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count() and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(docs).collect()), key=str)
    d = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    got = mixing.mix(d).groupBy("source_size", "target").sum("taken").collect()
    assert len(got) == 20 and all(abs(r["sum(taken)"] - r["target"]) <= 0.02 * r["target"] for r in got)
    assert abs(sum(r["target"] for r in got) - 1.5 * sum(r["source_size"] for r in got)) < 1
    assert mixing.mix(empty).count() == 0
    assert mixing.resample(docs).columns == docs.columns and mixing.resample(empty).count() == 0


def test_mix_against_brute_force(spark):
    """Targets, multipliers (by bisection) and rates worked out one by one; copies lie beside the rates and their words near the targets."""
    rng = random.Random(17)
    rows = [(k, None if rng.random() < 0.02 else text_of(rng, 1 + int(rng.expovariate(1 / 40))), rng.choice(["a", "a", "a", "a", "b", "c", "c", None])) for k in range(3000)]
    size = {k: len((t or "").split()) for k, t, _ in rows}
    for weights, scale in (((3, 1, 2), 1.5), ((1, 9, 4), 0.7)):
        got = {r["doc_id"]: r for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=weights, scale=scale).collect()}
        total = {s: sum(size[k] for k, _, x in rows if x == s) for s in ("a", "b", "c", None)}
        weight = dict(zip(total, (*weights, weights[0]), strict=True))
        target, free, left = {}, set(total), scale * sum(total.values())
        while True:
            share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
            over = {s for s in free if share[s] > 2 * total[s]}
            if not over:
                target |= share
                break
            target |= {s: 2 * total[s] for s in over}
            left, free = left - sum(2 * total[s] for s in over), free - over
        for s in total:
            mine = [size[k] for k, _, x in rows if x == s]
            mean = sum(mine) / sum(n > 0 for n in mine)
            rate = lambda lam, n, mean=mean: min(2.0, np.exp(min(50, lam * n / mean)))
            low, high = -60 * mean, 60 * mean
            for _ in range(200):
                mid = (low + high) / 2
                low, high = (mid, high) if sum(n * rate(mid, n) for n in mine) < target[s] else (low, mid)
            own = [got[k] for k, _, x in rows if x == s]
            assert all(r["target"] == pytest.approx(target[s]) and r["source_size"] == total[s] and r["size"] == size[r["doc_id"]] for r in own)
            if target[s] < 2 * total[s] - 1:
                assert all(r["rate"] == pytest.approx(rate(high, r["size"]), rel=1e-4) for r in own)
            assert all(int(r["rate"] + 1e-9) <= r["copies"] <= 2 for r in own) and np.mean([abs(r["copies"] - r["rate"]) < 1 for r in own]) > 0.98
            assert abs(sum(r["taken"] for r in own) - target[s]) <= 2


def brute_substrings(rows, length=100):
    seen, out = set(), collections.Counter()
    tie = lambda x: int.from_bytes(hashlib.sha256(x).digest()[:8], "big", signed=True)
    for i, x in sorted(((i, t.encode()) for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, tie(r[1]))):
        gone = np.zeros(len(x), bool)
        for p in range(len(x) - length + 1):
            w = x[p : p + length]
            if w in seen:
                gone[p : p + length] = True
            seen.add(w)
        kept = np.frombuffer(x, np.uint8)[~gone].tobytes()
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if len(x) else 0
        out[(i, len(x), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())] += 1
    return out


def test_substrings(docs, empty, spark, monkeypatch):
    small = docs.where("doc_id IS NULL OR doc_id <> 10")
    for large in (50_000, 2):  # 2: nearly every bucket takes the other way
        monkeypatch.setattr(substrings, "LARGE", large)
        monkeypatch.setattr(substrings, "CHUNK", 2000)
        got = collections.Counter(map(tuple, substrings.deduplicate(small, sample=1).collect()))
        assert got == brute_substrings(ordered(small))
    long = {r["doc_id"]: r["n_removed"] for r in substrings.deduplicate(docs).collect()}
    assert long[10] == 200_000 - 1  # all but the first byte of a run of one letter
    assert substrings.deduplicate(empty).count() == 0


def test_quality(spark, docs, empty):
    d, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r["doc_id"]: r["keep"] for r in quality.classify(d, labels).collect()}
    known = [(r["quality"], r["toxic"], got[r["doc_id"]]) for r in labels.collect()]
    assert np.mean([k for q, t, k in known if q == 1 and not t]) > 0.97
    assert np.mean([k for q, _, k in known if q == 0]) < 0.4
    assert all(r["keep"] for r in quality.classify(docs, labels.limit(0)).collect())
    assert quality.classify(empty, labels).count() == 0
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {3, 4} <= {r["doc_id"] for r in kept.collect()}


def test_quality_without_language(spark):
    rng = random.Random(4)
    d = spark.createDataFrame([*((k, text_of(rng, 80), None if k % 2 else "en") for k in range(60)), (60, "qzx#kvj@ " * 50, None), (61, None, None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(50)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.classify(d, labels).collect()}
    assert got[1]["lang"] is None and got[0]["lang"] == "en" and all(got[k]["perplexity"] for k in range(61))
    assert not got[60]["keep"] and got[61]["keep"] and got[61]["perplexity"] is None
    assert 60 not in {r["doc_id"] for r in quality.keep_good(d, labels).collect()}


def test_thin_bands_take_their_neighbours_limits(spark):
    rng = random.Random(14)
    texts = [*(f"w{k}" for k in range(40)), *(text_of(rng, 130) for _ in range(60)), *(text_of(rng, 260) for _ in range(5))]
    d = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    rows = quality.classify(d, spark.createDataFrame([(k, 1, 0) for k in range(105)], "doc_id long, quality int, toxic int"), least=20).collect()
    most = max(r["perplexity"] for r in rows if r["doc_id"] >= 40)
    assert all(r["high"] <= 1.021 * most for r in rows if r["doc_id"] >= 100)
    assert max(r["perplexity"] for r in rows if r["doc_id"] < 40) > 2 * most
    assert quality.merged({("a", 5): 9, ("a", 7): 2}, 10)[6] == ("a", 6, [5, 7]) and quality.merged({("a", 5): 9, ("a", 7): 2}, 3)[5] == ("a", 5, [5])


def brute_kneser_ney(texts):
    """Perplexity a byte of a text, by interpolated modified Kneser-Ney over the texts' byte 5-grams."""
    grams = lambda t: [w[k : k + 5] for w in [b"\2" * 4 + t.encode()] for k in range(len(w) - 4)]
    n = {5: collections.Counter(g for t in texts for g in grams(t))}
    for k in (4, 3, 2, 1):
        n[k] = collections.Counter(g[1:] for g in n[k + 1])
    d, total, held = {}, {k: collections.Counter() for k in n}, {k: collections.Counter() for k in n}
    for k, c in n.items():
        t = [sum(x == i for x in c.values()) for i in range(5)]
        y = t[1] / (t[1] + 2 * t[2]) if t[1] + t[2] else 0.5
        d[k] = [0, *(max(0.05, min(i, i - (i + 1) * y * t[i + 1] / t[i] if t[i] and t[1] else 0.5 * i)) for i in (1, 2, 3))]
        for g, x in c.items():
            total[k][g[:-1]] += x
            held[k][g[:-1]] += d[k][min(x, 3)]

    def p(g):
        k = len(g)
        lower = p(g[1:]) if k > 1 else 1 / (len(n[1]) + 1)
        if g[:-1] not in total[k]:
            return lower
        return (max(0, n[k][g] - d[k][min(n[k][g], 3)]) + held[k][g[:-1]] * lower) / total[k][g[:-1]]

    return lambda t: float(np.exp(-np.mean([np.log(p(g)) for g in grams(t)])))


def test_quality_against_brute_force(spark):
    """Each perplexity is that of the half of the trusted text which a text is not in, each limit a quantile of them."""
    rng = random.Random(9)
    texts = [text_of(rng, rng.randint(1, 60)) for _ in range(40)]
    rows = [*enumerate(texts), (40, texts[0]), (41, None), (42, ""), (43, "zebra é漢 " + texts[1]), (44, "#" * 500)]
    d = spark.createDataFrame([(k, "en", t) for k, t in rows], "doc_id long, lang string, text string")
    labels = spark.createDataFrame([*((k, 1, 0) for k in range(40)), (44, 0, 0)], "doc_id long, quality int, toxic int")
    of = {r["doc_id"]: (r["own"], r["other"]) for r in d.select("doc_id", quality.half_model(False).alias("own"), quality.half_model(True).alias("other")).collect()}
    brute = {m: brute_kneser_ney([t for k, t in enumerate(texts) if of[k][0] == m]) for m in {of[k][0] for k in range(40)}}
    assert len(brute) == 2
    got = {r["doc_id"]: r for r in quality.classify(d, labels).collect()}
    for k, t in rows:
        if t:
            assert got[k]["perplexity"] == pytest.approx(brute[of[k][1]](t), rel=1e-5) and got[k]["n"] == len(t.encode())
        else:
            assert got[k]["perplexity"] is None and got[k]["keep"]
    logs = [round(np.log(got[k]["perplexity"]), 4) for k in range(40)]  # under `least` rows, so all bands have these limits
    lo, hi = np.exp(np.quantile(logs, 0.002)) / 1.02, np.exp(np.quantile(logs, 0.995)) * 1.02
    assert all(got[k]["keep"] == (lo <= got[k]["perplexity"] <= hi) for k, t in rows if t) and not got[44]["keep"]


def test_near_join(docs, empty):
    rows = nearjoin.near_join(docs).collect()
    sets = [(i, frozenset(nearjoin.run_set(t).tolist())) for i, t in ordered(docs)]
    like = lambda a, b: 1.0 if a == b else len(a & b) / len(a | b)
    want = collections.Counter((i, sum(like(s, o) >= 0.8 for k, (_, o) in enumerate(sets) if k != j)) for j, (i, s) in enumerate(sets))
    assert collections.Counter((r["doc_id"], r["n_links"]) for r in rows) == want
    classes = {r["doc_id"]: r["class_id"] for r in rows}
    assert classes[2] == 1 and classes[7] == 6 and classes[5] == classes[4] == 3
    kept = nearjoin.keep_first(docs)
    ids = sorted(r["doc_id"] for r in kept.collect())
    assert kept.columns == docs.columns and ids == [1, 3, 6, 8, 9, 9, 10, 12]  # 11 is 8 twice over
    assert nearjoin.near_join(empty).count() == 0 and nearjoin.keep_first(empty).count() == 0


def test_keep_first_of_classes_that_share_an_id(spark):
    rng = random.Random(8)
    a, b, c, e = (text_of(rng, 200) for _ in range(4))
    d = spark.createDataFrame([(1, a), (2, a), (1, b), (3, b + " plus"), (None, c), (None, c + " plus"), (None, e), (None, e)], "doc_id long, text string")
    kept = [(r["doc_id"], r["text"]) for r in nearjoin.keep_first(d).collect()]
    assert len(kept) == 4 and {(1, a), (1, b), (None, e)} < set(kept) and {t[:50] for _, t in kept} == {x[:50] for x in (a, b, c, e)}


PAGES = [
    ("<html><head><title>T</title></head><body><nav><a href=x>Home</a></nav><article><header><h1>A &amp; B</h1></header><p>One<br>two <b>three</b></p><p>&lt;x&gt;&nbsp; y<script>var a='</p>'</script></p><aside>no</aside></article><footer>f</footer>", "A & B\nOne two three\n<x> y"),
    ("<div class='cookie-notice'>We use cookies and you agree to it all.</div><main><p>Short.</p><form><label>Name</label></form><section id='comments'><article class='comment'><p>First!</p></article></section></main>", "Short."),
    ("", ""),
    ("no markup at all, but it is a sentence of the kind that stands for the text of a page, and so it is kept as it was", "no markup at all, but it is a sentence of the kind that stands for the text of a page, and so it is kept as it was"),
    ("<p><a href=1>one</a> <a href=2>two</a> <a href=3>three</a></p><h2>Head</h2><p>This is the text of the page, and it has the words that all of it needs to be more than a list of links in the page.</p><p>Short end.</p><p><a href=4>more links of the site</a></p>", "Head\nThis is the text of the page, and it has the words that all of it needs to be more than a list of links in the page.\nShort end."),
]


@pytest.mark.parametrize("page, want", PAGES)
def test_main_text(page, want):
    assert html.main_text(page) == want


BODY = "This is the text of the page, and it has the words that all of it needs to be more than a list of links in the page."
BODY_2 = "It is not in an article, but the words of it say that they are what the page was made for, and so they have to be kept."
LINKS = "<ul><li><a href=1>one more page</a></li><li><a href=2>another page</a></li></ul>"


@pytest.mark.parametrize("page, want", [
    (f"<div><p>{BODY}</p><p>{BODY_2}</p></div><aside><article><h3>Teaser</h3><p>{BODY[:60]}</p></article></aside>", f"{BODY}\n{BODY_2}"),
    (f"<div class='related'><article><p>{BODY}</p></article></div><div><p>{BODY_2}</p></div>", BODY_2),
    (f"<div><p>{BODY}</p><p>{BODY_2}</p></div><div><article><p><a href=1>A teaser</a></p></article><article><p><a href=2>And one more</a></p></article></div>", f"{BODY}\n{BODY_2}"),
    (f"<main><h1><a href=0>Head</a></h1><p>{BODY}</p><h2>More</h2>{LINKS}</main>", f"Head\n{BODY}"),
    (f"<div>{BODY[:75]}</div><article><p>{BODY}</p><p>Short.</p></article>", f"{BODY}\nShort."),
    (f"<form><article><p>{BODY}</p></article></form>", BODY),
    (f"<div hidden><article><p>{BODY}</p></article></div>", ""),
])
def test_main_parts_are_one_feature(page, want):
    assert html.main_text(page) == want


def test_main_text_table(spark):
    pages = spark.createDataFrame([(1, "u", None, 1), (None, None, "<article><p>x", 2)], "page_id long, url string, html string, text int")
    assert {tuple(r) for r in html.extract(pages).collect()} == {(1, "u", "", 0), (None, None, "x", 1)}


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF).collect()
    starts = sorted((r["start"], r["n_tokens"]) for r in out)
    assert out and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))
    assert "pipeline" in queries() and len(corpus_pipeline.STAGES) == 5


def test_words_keep_the_ids_of_whole_texts(tmp_path):
    """Marks, rare blanks, letters that become letter and mark, and special tokens in any case, next to full stops and commas."""
    enc = tokens.Encoder(tokenizer_path())
    assert enc.parted
    atoms = "a Z é É ß İ ı µ Å ÿ Ÿ 0 7 . , ! ? _ - ' ’ 漢 あ 😀 ﬁ ½ ² Σ ς क़ the Hello WORLD 's <|endoftext|> <|ENDOFTEXT|> <|startoftext|> [UNK] a.b 1,000 ., _.".split(" ")
    atoms += [" ", "  ", "\n", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x1f", "\x85", "\xa0", "\u2028", "\u3000", "\u200b", "\ufeff", "\xad", "\u0301", "\x00", ". ", ", "]
    rng = random.Random(11)
    texts = ["".join(rng.choices(atoms, k=rng.randint(0, 14))) for _ in range(4000)]
    ids, sizes = enc(pa.array(texts))
    got = [list(map(int, x)) for x in np.split(ids, np.cumsum(sizes)[:-1])]
    assert got == [enc.tok.encode(t, add_special_tokens=False).ids for t in texts]

    from tokenizers import Tokenizer, models, pre_tokenizers

    other = Tokenizer(models.WordLevel({"A": 0, "a": 1, "?": 2}, unk_token="?"))
    other.pre_tokenizer = pre_tokenizers.Whitespace()
    other.save(str(tmp_path / "cased.json"))
    plain = tokens.Encoder(str(tmp_path / "cased.json"))
    ids, sizes = plain(pa.array(["A a", "", "a b"]))
    assert not plain.parted and ids.tolist() == [0, 1, 1, 2] and sizes.tolist() == [2, 0, 2]
