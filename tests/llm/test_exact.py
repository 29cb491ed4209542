"""The corpus operators against brute force, exact round trips and held-out accuracy."""

import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barloom.llm import common, decontam, licenses, linededup, packing, pseudo, quality, queries, rules, simhash, simple8b, surrogates
from barloom.llm.tokens import TextEncoder

TOKENIZERS = ("byte_bpe_50k.json", "word_bpe_49k.json")


def frame(spark, texts, start=0):
    return spark.createDataFrame([(start + k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)


# ---------------------------------------------------------------- tokens


@pytest.fixture(scope="module")
def encoders():
    from tokenizers import Tokenizer

    out = {}
    for name in TOKENIZERS:
        out[name] = (TextEncoder(queries.tokenizer_path(name)), Tokenizer.from_file(queries.tokenizer_path(name)))
    return out


PLAIN = st.text(alphabet=st.one_of(st.sampled_from(list(" \n\t.,'!#1290abcdeXYZéÉßñü  İσς")), st.characters(blacklist_categories=("Cs",))), max_size=60)
NAMED = st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|", "|>", " "])
TEXT = st.one_of(PLAIN, st.lists(st.one_of(NAMED, PLAIN), max_size=6).map("".join))


@settings(max_examples=600, deadline=None)
@given(TEXT)
def test_piecewise_ids_are_the_librarys(encoders, text):
    for own, whole in encoders.values():
        assert own.ids(text).tolist() == whole.encode(text, add_special_tokens=False).ids


# ---------------------------------------------------------------- Simple-8b


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 65535), st.integers(0, 2**64 - 1)), max_size=300), st.integers(1, 64))
def test_simple8b_round_trip(values, block):
    ids = np.array(values, np.uint64)
    payload = simple8b.encode(ids, block)
    assert simple8b.decode(payload).tolist() == values
    for a, b in ((0, 5), (len(values) // 3, 2 * len(values) // 3), (len(values) // 2, len(values) + 9)):
        assert simple8b.decode(payload, a, b).tolist() == values[a:b]


def test_special_literals_in_queries(spark, tmp_path, encoders):
    """op2 and op7 against an untouched tokenizer over texts that hold its special tokens."""
    texts = ["a <|endoftext|> b", "<|startoftext|>x<|endoftext|>", "plain words", "<|ENDOFTEXT|> " * 3, "", None, "  two  <|endoftext|>"]
    spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    own = lambda name, end: {k: [*encoders[name][1].encode(t or "", add_special_tokens=False).ids, end] for k, t in enumerate(texts)}
    crc = {k: zlib.crc32(np.array(ids, "<u4").tobytes()) for k, ids in own(TOKENIZERS[0], 0).items()}
    assert {r.doc_id: r.ids_crc32 for r in queries.op2_simple8b_tokens(spark, str(tmp_path)).collect()} == crc
    got = {}
    for r in sorted(packing.pack(spark.read.parquet(f"{tmp_path}/documents.parquet"), queries.tokenizer_path(TOKENIZERS[1]), 2).collect(), key=lambda r: (r.doc_id, r.start)):
        got.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert got == own(TOKENIZERS[1], 2)


def test_recurring_words_are_cut_once(monkeypatch):
    """The memo of whole words holds two generations of twice MEMO; a word with a mark is the word and the mark."""
    from string import punctuation

    from barloom.llm import tokens

    monkeypatch.setattr(tokens, "MEMO", 50)
    enc, cut = tokens.TextEncoder(queries.tokenizer_path("byte_bpe_50k.json")), []
    one = enc.pieces.encode
    enc.pieces.encode = lambda w: cut.append(w) or one(w)
    text = " ".join(["Start", *[f"wo{chr(97 + k % 26)}r{chr(97 + k // 26)}" for k in range(90)]])
    first, again = enc.ids(text), enc.ids(text)
    assert first.tolist() == again.tolist() == enc.tok.encode(text, add_special_tokens=False).ids and len(cut) == 90
    for text in [f"{head} river{c} old{c}town é{c} {c} {c}{c} x{c}\n{c}y 7{c} don{c}t" for c in punctuation for head in ("A", "", "Über", f"a{c}")]:
        assert enc.ids(text).tolist() == enc.tok.encode(text, add_special_tokens=False).ids, text


def test_a_full_memo_leaves_an_executor_room():
    """Two workers' memos stand beside an executor's heap; a word and several marks are two pre-tokens."""
    import sys

    from barloom.llm import tokens

    enc = tokens.TextEncoder(queries.tokenizer_path("byte_bpe_50k.json"))
    one, enc.pieces.encode = enc.pieces.encode, str.encode
    most = 0
    for k in range(3 * enc.pieces.most):
        enc.pieces[f"word{k:06d}"]
        most = max(most, len(enc.pieces) + len(enc.pieces.old))
    assert most <= 2 * enc.pieces.most
    held = sum(sys.getsizeof(x) + sys.getsizeof(y) for x, y in enc.pieces.old.items()) + sys.getsizeof(enc.pieces.old)
    assert 2 * held < 160e6
    enc.pieces.encode = one
    for text in [f"Über town{a}{b} é{b}{a} x{a}{b}{c} {a}{b}x" for a in "'.,$" for b in "\"'-)" for c in "!\n7s"]:
        assert enc.ids(text).tolist() == enc.tok.encode(text, add_special_tokens=False).ids, text


def test_simple8b_packs_by_width():
    words = lambda ids: simple8b._HEAD.unpack_from(simple8b.encode(np.array(ids, np.uint64)))[3]
    assert words([1] * 60) == 1 and words([1000] * 12) == 2 and words([2**61]) == 2


def test_files_round_trip(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = sorted(queries.op2_simple8b_tokens(spark, sf).collect(), key=lambda r: r.doc_id)
    enc, at = TextEncoder(queries.tokenizer_path(TOKENIZERS[0])), 0
    for d, r in zip(sorted(docs.collect(), key=lambda r: r.doc_id), out, strict=True):
        ids = [*enc.ids(d.text).tolist(), 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


# ---------------------------------------------------------------- packing


def test_packing_holds_every_id_once(spark, sf):
    enc = TextEncoder(queries.tokenizer_path(TOKENIZERS[1]))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op7_packing(spark, sf).collect()
    pieces, windows = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        windows.setdefault(r.sequence_id, []).append(r)
    for doc, text in texts.items():
        ids, at = np.array([*enc.ids(text).tolist(), 2], "<u4"), 0
        for r in sorted(pieces[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = total = 0
    for own in windows.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
        total += at
        padding += 4096 - at if at & (at - 1) else 0
    assert padding < 0.02 * total


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 90), max_size=80))
def test_windows_are_bounded(sizes):
    state, out = packing.Windows(32, 4, 2), []
    for doc, n in enumerate(sizes):
        out += list(state.place((doc, 0, n, np.arange(n))))
        assert len(state.rooms) <= 4
    out += packing.merge(state.rest(), 32, 2)
    assert all(sum(len(p[3]) for p in w) <= 32 for w in out)
    seen = sorted((d, s + i) for w in out for d, s, _, ids in w for i in range(len(ids)))
    assert seen == [(d, i) for d, n in enumerate(sizes) for i in range(n)]


# ---------------------------------------------------------------- SimHash


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[k : k + 3]), 42) for k in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(values, linked):
    label = list(range(len(values)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for i in range(len(values)):
        for j in range(i):
            if linked(values[i], values[j]):
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return [root(k) for k in range(len(values))]


def test_fingerprints():
    r = random.Random(1)
    texts = [" ".join(r.choice(["Ab", "cd", "É", "x1"]) for _ in range(r.randint(0, 40))) for _ in range(600)]
    assert simhash.fingerprints(texts).tolist() == [slow_fingerprint(t) for t in texts]


@pytest.mark.parametrize("cell", [1, 128])
def test_links_have_the_components_of_all_pairs(spark, monkeypatch, cell):
    """cell 1 sends every shared cell through the words one bit away."""
    monkeypatch.setattr(simhash, "CELL_MAX", cell)
    r = random.Random(2)
    fps = {0, 2**64 - 1}
    for _ in range(30):
        x = r.getrandbits(64)
        for _ in range(12):
            fps.add(x)
            for _ in range(r.randint(1, 3)):
                x ^= 1 << r.randrange(64)
    fps = sorted(fps)
    signed = [x - 2**64 if x >> 63 else x for x in fps]
    distinct = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = {row.id: row.component for row in common.components(simhash.links(distinct)).collect()}
    own = groups(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    mine = [found.get(s, s) for s in signed]
    assert len(set(zip(own, mine))) == len(set(own)) == len(set(mine))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501)], "a long, b long")
    found = {r.id: r.component for r in common.components(edges).collect()}
    assert {found[k] for k in range(201)} == {0} and found[501] == 500


# ---------------------------------------------------------------- lines


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


@settings(max_examples=500, deadline=None)
@given(st.text("ab", max_size=12), st.text("ab", max_size=12), st.integers(1, 4))
def test_banded_distance(a, b, k):
    assert linededup.edit_distance(a, b, k) == min(k + 1, slow_distance(a, b))


def near_lines(r, n, edits):
    out = []
    for _ in range(n):
        base = "".join(r.choice("abcdé ") for _ in range(r.randint(20, 40)))
        out.append(base)
        for _ in range(3):
            x = list(base)
            for _ in range(r.randint(0, edits + 1)):
                p = r.randrange(len(x))
                x[p : p + r.randint(0, 1)] = r.choice(["", "z", "q"])
            out.append("".join(x))
    return out


@pytest.mark.parametrize(("edits", "bucket"), [(1, 512), (1, 1), (2, 512), (2, 1)])
def test_line_links_are_all_pairs_within_the_edits(spark, monkeypatch, edits, bucket):
    monkeypatch.setattr(linededup, "BUCKET_MAX", bucket)
    r = random.Random(edits)
    lines = near_lines(r, 40, edits)
    r.shuffle(lines)
    texts = ["\n".join(lines[k : k + 4]) for k in range(0, len(lines), 4)]
    run = linededup.LineDedup(frame(spark, texts), edits=edits)
    place = {}
    for d, t in enumerate(texts):
        for n, line in enumerate(t.split("\n")):
            place.setdefault(line, (d, n))
    first = sorted(place.items(), key=lambda x: x[1])
    pairs = {(a, b) for i, (a, _) in enumerate(first) for b, _ in first[i + 1 :] if min(len(a), len(b)) >= linededup.MIN_CHARS and slow_distance(a, b) <= edits}
    assert run.links.count() == len(pairs)
    later = {b for _, b in pairs}
    gone = {(d, n) for d, t in enumerate(texts) for n, line in enumerate(t.split("\n")) if line in place and (place[line] != (d, n) or line in later)}
    assert {(x.doc_id, x.line) for x in run.dropped.collect()} == gone
    kept = {d: "\n".join(line for n, line in enumerate(t.split("\n")) if (d, n) not in gone) for d, t in enumerate(texts)}
    assert {x.doc_id: x.text for x in run.apply(None).collect()} == {d: t for d, t in kept.items() if t.strip()}


def test_repeated_keys_with_different_texts_keep_their_unique_lines(spark):
    rows = [(5, "a line that stands in doc one as well\nshort"), (5, "a unique line of the other row here\nshort"), (1, "a line that stands in doc one as well"), (9, "ж" * 30 + "\nshort"), (8, "ж" * 29 + "я")]
    docs = spark.createDataFrame([(k, t, None, "g") for k, t in rows], "doc_id long, text string, _gone string, lines string").repartition(3)
    out = sorted((r.doc_id, r.text) for r in linededup.dedup_lines(docs).apply().collect())
    shorts = [t for k, t in out if k == 5]
    assert sum("short" in t for t in shorts) == 1 and sum("unique line" in t for t in shorts) == 1
    assert (8, "ж" * 29 + "я") in out and not any(k == 9 for k, _ in out)
    named = docs.withColumn("doc_id", F.concat(F.lit("k"), F.col("doc_id").cast("string")))
    assert sorted(r.text for r in linededup.dedup_lines(named).apply().collect()) == sorted(t for _, t in out)


def test_numbered_lines_end(spark):
    """20,000 lines that agree on all but their number: links by brute force over the numbers."""
    lines = [f"receipt number {k:06d} of the city's water works" for k in range(0, 60_000, 3)]
    run = linededup.LineDedup(frame(spark, ["\n".join(lines[k : k + 500]) for k in range(0, len(lines), 500)]))
    held, own = {f"{k:06d}" for k in range(0, 60_000, 3)}, 0
    for x in held:
        own += sum(x[:i] + d + x[i + 1 :] in held for i in range(6) for d in "0123456789" if d != x[i])
    assert run.links.count() == own // 2


# ---------------------------------------------------------------- decontamination


def test_templates_catch_new_parameters_and_refuse_inconsistent_slots(spark):
    item = "A train leaves for Paris with 120 people and after 15 minutes another 120 people board the same train there"
    other = item.replace("120", "85").replace("15", "40").replace("Paris", "Rome")
    broken = item.replace("120", "85", 1)
    docs = frame(spark, [f"Some words before. {item} and more after", f"x {other} y", f"x {broken} y", "clean words " * 30, None, item.upper()])
    items = spark.createDataFrame([(7, item), (8, "too short"), (9, None)], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r for r in decontam.leaks(docs, items).collect()}
    assert set(found) == {(0, 7), (1, 7), (5, 7)}  # in capitals the name isn't one, but the words after it match
    assert found[5, 7].covered < found[0, 7].covered
    assert found[0, 7].covered == len(item.split()) and found[0, 7].n_slots == 4


def leaked(spark, item, *texts):
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    return {r.doc_id for r in decontam.leaks(frame(spark, texts), items).collect()}


def test_items_made_of_numbers_are_caught_verbatim(spark):
    item = "Compute 12 + 7 * 9 - 4 / 2 + 8 * 3"
    assert leaked(spark, item, f"x y. {item} end", item.replace("7", "6"), "1 2 3 4 5 6 7 8 9 10 11 12") == {0}


def test_two_item_values_may_become_one(spark):
    item = "A crate holds 3 red balls and 5 blue balls so how many balls are there in it now"
    assert leaked(spark, item, item.replace("3", "4").replace("5", "4"), item.replace("3", "6")) == {0, 1}
    same = item.replace("5", "3")
    assert leaked(spark, same, same.replace("3", "4"), same.replace("3", "4", 1)) == {0}


def test_short_items_are_caught_in_mid_sentence(spark):
    item = "Which large river crosses the old stone town"
    assert leaked(spark, item, f"inly to {item} As", f"Reou en. {item} x", item, "much else " * 9) == {0, 1, 2}
    item = "Tom has 5 apples and buys more apples today"
    other = item.replace("Tom", "Ann").replace("5", "7")
    assert leaked(spark, item, f"so {other} x", f"So. {other} x", f"so {item} x", other.replace("apples", "pears", 1)) == {0, 1, 2}
    assert leaked(spark, "Tom sold nine old cars", "inly to Tom sold nine old cars As") == {0}


def test_very_short_items_are_caught_verbatim(spark):
    assert leaked(spark, "What is 2+2?", "so. What is 2+2? four", "what is 2 + 3", "What is it") == {0}
    assert leaked(spark, "Capital of France?", "The capital of France is", "Capital of Spain") == {0}
    assert leaked(spark, "Of what", "of what") == set()


def test_windows_that_many_items_share(spark, monkeypatch):
    """Items that differ behind a long common start: the same leaks whether common windows propose or not."""
    start = "Choose the right answer to the following question about the old town and its river"
    items = [(k, f"{start} where word{k} stands by other{k} near {'thing' * (k % 3 + 1)}{k} now") for k in range(12)] + [(50, start)]
    docs = frame(spark, [f"x {items[3][1]} y", f"x {items[5][1]} {items[7][1]}", f"and {start} only", "nothing of it " * 9])
    rows = spark.createDataFrame(items, "item_id long, text string")
    plain = {tuple(r) for r in decontam.leaks(docs, rows).collect()}
    monkeypatch.setattr(decontam, "COMMON", 4)
    found = {tuple(r) for r in decontam.leaks(docs, rows).collect()}
    own = {(0, 3), (1, 5), (1, 7), (2, 50)}
    assert own <= {r[:2] for r in found} <= {r[:2] for r in plain} and {r for r in plain if r[:2] in own} <= found
    assert not any(d == 3 for d, *_ in plain)


def test_windows_that_many_items_share_find_all_of_them(spark, monkeypatch):
    """Nothing is lost to common windows: classes of items give what each item against each document gives."""
    start = "Choose the right answer to the following question about the old town and its river"
    sums = "Tom has 5 apples and buys 7 more apples at the market in Rome before he sells 5 apples"
    items = [(k, f"{start} where word{k} stands by other{k}") for k in range(150)] + [(200 + k, f"{sums} then thing{k} follows") for k in range(150)]
    items += [(400 + k, sums) for k in range(3)] + [(500 + k, "old town and its river where a man sells 5 apples") for k in range(300)] + [(900, start), (900, sums)]
    texts = [f"and {start} only", f"x {items[3][1]} y", sums.replace("5", "8").replace("Rome", "Bonn"), sums.replace("5", "8", 1), f"{start} x {sums}", f"so {items[160][1]} x".replace("5", "9", 1), "old town and its river where a man sells 9 apples", "nothing of it " * 9]
    docs, rows = frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontam, "COMMON", 1 << 30)
    plain = sorted(map(tuple, decontam.leaks(docs, rows).collect()))
    kept = {r.doc_id for r in decontam.drop_leaks(docs, rows).collect()}
    assert len({r for r in plain if r[0] == 0}) >= 151 and len(plain) > 900
    for most in (256, 100, 2):
        monkeypatch.setattr(decontam, "COMMON", most)
        assert sorted(map(tuple, decontam.leaks(docs, rows).collect())) == plain
        assert {r.doc_id for r in decontam.drop_leaks(docs, rows).collect()} == kept == {r.doc_id for r in docs.collect()} - {r[0] for r in plain}


def test_leaks_against_brute_force(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    own = {(d.doc_id, i.item_id) for d in docs.collect() for i in items.collect() if i.text in d.text}
    assert own and {(r.doc_id, r.item_id) for r in queries.op3_template_decontamination(spark, sf).collect()} == own


# ---------------------------------------------------------------- language model


def test_network_gradient():
    r = np.random.default_rng(0)
    x, y = r.integers(0, pseudo.INPUTS, (40, pseudo.PLACES)), r.integers(0, pseudo.CLASSES, 40)
    net = pseudo.Network()
    g = net.gradient(x, y)
    a, b, c, _ = np.cumsum(pseudo.SIZES)
    for k in (int(x[0, 0]) * pseudo.HIDDEN + 1, a + 3, b + 5, c + 7):
        loss = []
        for d in (-1e-2, 1e-2):
            flat = net.flat.astype(np.float64)
            flat[k] += d
            loss.append(-pseudo.Network(flat).log_probabilities(x, y).mean())
        assert abs((loss[1] - loss[0]) / 2e-2 - g[k]) < 1e-4


def test_scores_are_sums_of_conditionals(spark):
    texts = ["the cat sat on the mat", "the dog sat on the log the end", "zebra quark", ""] * 5
    docs = frame(spark, texts)
    counts, near = pseudo.gather(docs)
    assert counts.agg(F.sum("n")).first()[0] == sum(len(t.split()) for t in texts)
    code = lambda w: int(pseudo.word_hashes([w.encode()])[1][0])
    sat = near.where(F.col("bucket") == code("sat") % pseudo.BUCKETS).first()
    sign = lambda w, k: 2 * (code(w) >> 32 + k & 1) - 1
    assert sat.s0 == 5 * (sign("cat", 0) + sign("dog", 0)) and sat[f"s{pseudo.SIGNS - 1}"] == 10 * sign("on", pseudo.SIGNS - 1)
    vocab = pseudo.vocabulary(counts, near)
    net = pseudo.train(docs, vocab)
    rows = {r.doc_id: r for r in pseudo.score(docs, vocab, net).collect()}
    for k, t in enumerate(texts[:4]):
        _, bucket, x = vocab.windows([t.encode()])
        total = 0.0
        for b, around in zip(bucket, x):
            h = np.tanh(net.bias + sum(net.table[around[j] + j * pseudo.INPUTS] for j in range(pseudo.PLACES)))
            logits = h @ net.out + net.prior
            total += logits[vocab.kind[b]] - np.log(np.exp(logits).sum()) + vocab.share[b]
        assert rows[k].n_words == len(t.split()) and abs(rows[k].log_likelihood - total) < 1e-3
    mass = np.zeros(pseudo.CLASSES)
    np.add.at(mass, vocab.kind, np.exp(vocab.share))
    assert np.allclose(mass[np.unique(vocab.kind)], 1)


def test_context_beats_word_counts_in_every_layout(spark, monkeypatch):
    """The same scores from 1, 4 and 64 partitions and with many shards, well above those of word counts alone."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    counts, near = pseudo.gather(docs)
    vocab = pseudo.vocabulary(counts, near)
    total = sum(r.n for r in counts.collect())
    unigram = sum(r.n * np.log(r.n / total) for r in counts.collect()) / total
    per_word = lambda rows: sum(r.log_likelihood for r in rows.values()) / sum(r.n_words for r in rows.values())
    first = None
    for n in (1, 4, 64):
        rows = {r.doc_id: r for r in pseudo.pseudo_likelihood(docs.repartition(n)).collect()}
        assert per_word(rows) > unigram + 0.12
        first = first or rows
        assert max(abs(rows[k].per_word - r.per_word) for k, r in first.items() if r.n_words) < 1e-3
    monkeypatch.setattr(pseudo, "SHARD_WORDS", 30_000)
    monkeypatch.setattr(pseudo, "FAN", 2)
    many = {r.doc_id: r for r in pseudo.score(docs, vocab, pseudo.train(docs, vocab), counts=counts).collect()}
    assert per_word(many) > unigram


@pytest.mark.parametrize("hot", [1, 1 << 16])
def test_words_of_one_bucket_have_their_own_shares(spark, monkeypatch, hot):
    """hot 1 sends all words but one through the join."""
    monkeypatch.setattr(pseudo, "HOT", hot)
    code = lambda w: int(pseudo.word_hashes([w.encode()])[1][0])
    held = {}
    for w in (f"w{k}" for k in range(2000)):
        held.setdefault(code(w) % pseudo.BUCKETS, []).append(w)
    often, rare = next(ws for ws in held.values() if len(ws) == 2)
    texts = [f"{often} " * 40 + rare, f"the {rare} the", f"the {often} the", "the", ""]
    docs = frame(spark, texts)
    vocab, net = pseudo.vocabulary(*pseudo.gather(docs)), pseudo.Network()
    rows = {r.doc_id: r for r in pseudo.score(docs, vocab, net).collect()}
    own = {often: 41 / 43, rare: 2 / 43, "the": 1.0}
    for k, t in enumerate(texts[:4]):
        _, bucket, x = vocab.windows([t.encode()])
        want = net.log_probabilities(x, vocab.kind[bucket]) + vocab.share[bucket] + np.log([own[w] for w in t.split()])
        assert abs(rows[k].log_likelihood - want.sum()) < 1e-3
    assert rows[4].log_likelihood == 0


def test_sums_of_many_shards(spark):
    rows = [(k, k + 1, [float(k), 1.0]) for k in range(70)]
    n, total = pseudo._summed(spark.createDataFrame(rows, "shard long, n long, total array<double>"), 70)
    assert n == 70 * 71 // 2 and total.tolist() == [sum(range(70)), 70.0]
    assert pseudo._summed(spark.createDataFrame([], "shard long, n long, total array<double>"), 1) == (0, None)


# ---------------------------------------------------------------- rules


def slow_measure(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = {}
    for k in range(len(words) - 2):
        at.setdefault(tuple(words[k : k + 3]), []).append(k)
    covered = {k + j for ks in at.values() if len(ks) > 1 for k in ks for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_measurements(spark):
    r = random.Random(4)
    texts = [None, "", " \n\x0b", "a b c a b c a b c", "é𝒳 ü a b"] + ["".join(r.choice(["a ", "b ", "c", "\n", "# ", "É|", "\t", "\x85"]) for _ in range(r.randint(0, 120))) for _ in range(150)]
    rows = {x.doc_id: x for x in rules.measure(frame(spark, texts)).collect()}
    for k, t in enumerate(texts):
        x = rows[k]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == slow_measure(t), t


def test_ledger_policies_and_ablations(spark):
    long = " ".join(f"word{k}" for k in range(60))
    docs = frame(spark, ["few words", long, long + " ###" * 9, "same words here " * 30, "few #### ####"])
    entries = rules.ledger(docs)
    bits = {r.doc_id: r.fail_bits for r in entries.collect()}
    assert [bits[k] for k in range(5)] == [1, 0, 4, 2, 5]
    kept = lambda v: {r.doc_id for r in entries.where(~rules.failed(F.col("fail_bits"), rules.POLICIES[v])).collect()}
    assert kept(1) == {1, 2} and kept(2) == {1}
    odd = rules.ledger(docs, rules={"a": "n_words < 0", "too_short": "n_words < 50"})
    assert {r.doc_id for r in odd.where(rules.failed(F.col("fail_bits"), ("too_short",), {"a": "", "too_short": ""})).collect()} == {0, 4}
    out = {r.rule: (r.n_failed, r.n_only_this) for r in rules.ablations(entries, rules.POLICIES[2]).collect()}
    assert out["too_short"] == (2, 1) and out["symbols"] == (2, 1) and out["repeated_words"] == (1, 1) and out["upper_case"] == (0, 0)


def test_rules_run_no_python(spark, sf):
    plan = queries.op5_rule_ledger(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# ---------------------------------------------------------------- surrogates


@pytest.mark.parametrize("size", [1, 2, 3, 100, 1000])
def test_cycle_is_a_permutation_without_fixed_points(size):
    out = [surrogates._cycle(b"k" * 32, "t", x, size) for x in range(size)]
    assert sorted(out) == list(range(size)) and (size == 1 or all(a != b for a, b in enumerate(out)))


def test_surrogates_keep_type_format_and_identity():
    made = surrogates.Surrogates("secret")
    text = (
        "Mr. John Smith (john@mail3.example.com, JOHN@mail3.example.com) and Mrs Smith, Анна Петрова; +1 (487) 555-7209 or +14875557209; 4111 1111 1111 1111; "
        'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff", 10.1.2.3, 43.21.141.162, SSN 123-45-6789, DE89 3704 0044 0532 0130 00'
    )
    new, spans = surrogates.replace(text, made)
    of = {(k, text[s:e]): x for s, e, k, x, _ in spans}
    for (kind, old), x in of.items():
        assert x != old and len(x) >= 3
        if kind != "person":
            assert [c.isdigit() for c in x if not c.isalnum() or True][0] in (True, False) and (kind in ("ip", "hex", "secret") or [c for c in x if not c.isalnum()] == [c for c in old if not c.isalnum()])
    first = of["person", "John Smith"].split()
    assert first[0] in surrogates.GIVEN["m", "latin"] and of["person", "Smith"] == first[1]
    assert of["person", "Анна Петрова"].split()[0] in surrogates.GIVEN["f", "cyrillic"]
    assert of["email", "john@mail3.example.com"].lower() == of["email", "JOHN@mail3.example.com"].lower()
    digits = lambda x: [c for c in x if c.isdigit()]
    assert digits(of["phone", "+1 (487) 555-7209"]) == digits(of["phone", "+14875557209"])
    card = digits(of["card", "4111 1111 1111 1111"])
    assert surrogates._luhn("".join(card[:-1])) == int(card[-1]) and of["ip", "10.1.2.3"].startswith("10.")
    assert surrogates.Surrogates("other").of("ip", "43.21.141.162") != of["ip", "43.21.141.162"]


@settings(max_examples=60, deadline=None)
@given(st.sets(st.from_regex(r"[a-z]{2,3}\.[0-9]{2}@mail[0-9]\.example\.com", fullmatch=True), min_size=2, max_size=40))
def test_surrogates_are_distinct(emails):
    made = surrogates.Surrogates("secret")
    assert len({made.of("email", x) for x in emails}) == len(emails)


def one(made, text):
    """The only entity's surrogate."""
    ((_, _, _, x, _),) = surrogates.replace(text, made)[1]
    return x


def test_surrogates_of_every_kind():
    made = surrogates.Surrogates("k")
    for text in ("Hans Müller came", "Robin Weber came", "Fatima Hassan came", "Wei Zhang came", "William Johnson came", "Μαρία Παπαδοπούλου", "Señora Núñez", "Dr. Ýr Þórsdóttir"):
        ((s, e, kind, new, _),) = surrogates.replace(text, made)[1]
        assert kind == "person" and all(a != b for a, b in zip(text[s:e].split(), new.split(), strict=True))
    assert made.of("email", "用户@例子.com") not in ("用户@例子.com",) and made.of("email", "用户@例子.com").endswith(".com")
    assert len({one(made, f"{t} Robin Weber") for t in ("Mr", "Mrs", "Dr")}) == 3
    assert len({one(made, f"{t} Zdenka Weber") for t in ("Mr", "Mrs", "Dr")}) == 3
    assert one(made, "Mr Robin Weber").split()[0] in surrogates.GIVEN["", "latin"]
    assert one(made, "Mrs Anna Weber") == one(made, "Anna Weber") == one(made, "Dr. Anna Weber")
    for iban in ("DE89 3704 0044 0532 0130 00", "GB29NWBK60161331926819", "FR14 2004 1010 0505 0001 3M02 606"):
        new = one(made, f"to {iban} now")
        assert new != iban and new[:2] == iban[:2] and surrogates._mod97(new.replace(" ", "")) == 1
        assert [c == " " for c in new] == [c == " " for c in iban]
    assert surrogates.find("no DE88 3704 0044 0532 0130 00 and 4111 1111 1111 1112, 8687996969735503") == []
    digits = lambda x: re.sub(r"\D", "", x)
    phones = {digits(made.of("phone", x)) for x in ("+4915112345678", "+49 15112345678", "+49 (151) 123-45678")}
    assert len(phones) == 1 and phones.pop().startswith("49") and made.of("phone", "+35912345678").startswith("+359")


@settings(max_examples=200, deadline=None)
@given(st.sets(st.one_of(st.integers(0, 2**32 - 1), st.integers(10 << 24, (10 << 24) + 300), st.integers(172 << 24 | 16 << 16, 172 << 24 | 31 << 16), st.integers(192 << 24 | 168 << 16, (192 << 24 | 168 << 16) + 99)), max_size=30))
def test_addresses_stay_in_their_range_and_apart(values):
    import ipaddress

    made = surrogates.Surrogates("k")
    kind = lambda a: (a in ipaddress.ip_network("10.0.0.0/8"), a in ipaddress.ip_network("172.16.0.0/12"), a in ipaddress.ip_network("192.168.0.0/16"), a.is_loopback)
    of = {x: ipaddress.ip_address(made.of("ip", str(ipaddress.ip_address(x)))) for x in values}
    assert len(set(of.values())) == len(values)
    assert all(kind(ipaddress.ip_address(x)) == kind(a) and int(a) != x for x, a in of.items())


def test_collisions_are_counted(spark):
    rows = [([("person", "A B", 1), ("person", "a b", 2)],), ([("ip", "1.1.1.1", 5), ("phone", "+1 2", 7)],), ([("phone", "+12", 7)],)]
    frame = spark.createDataFrame(rows, "entities array<struct<kind string, surrogate string, entity bigint>>")
    assert [tuple(r) for r in surrogates.collisions(frame).collect()] == [("person", "a b", 2)]


def test_later_mentions_of_a_person_have_the_same_surrogate():
    made = surrogates.Surrogates("secret")
    text = "John Smith came. Smith left; John paid Mr. O'Hara's bill, SMITH's and Smith-Jones, not Smithson. O'Hara and Anna Weber's dog; Weber."
    new, spans = surrogates.replace(text, made)
    assert [text[s:e] for s, e, *_ in spans] == ["John Smith", "Smith", "John", "O'Hara", "SMITH", "Smith", "O'Hara", "Anna Weber", "Weber"]
    of = {text[s:e]: x for s, e, _, x, _ in spans}
    assert of["John Smith"] == of["John"] + " " + of["Smith"] and of["SMITH"] == of["Smith"].upper() and of["Anna Weber"].split()[1] == of["Weber"]
    assert new.count(of["Smith"]) == 3 and "not Smithson" in new
    assert surrogates.find("Smith left; John paid") == []
    assert "The end" in surrogates.replace("Mr. The came. The end.", made)[0]


@pytest.mark.parametrize("text", ["password = correcthorsebattery", "API_TOKEN: 'abcdefghijklmnop'", "Secret=abcdefghijklmnop", "x " + "deadbeef".replace("b", "c") * 4])
def test_secrets_need_no_digit_elsewhere(text):
    assert surrogates.find(text) and surrogates.find(text) == surrogates.find(text + " and 7")


def test_no_entity_of_the_table_is_left(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = surrogates.pseudonymize(docs, "k")
    assert surrogates.collisions(found).count() == 0
    new = {r.doc_id: r for r in found.collect()}
    n = 0
    for d in docs.collect():
        for s, e, _ in surrogates.find(d.text):
            n += 1
            assert d.text[s:e] not in new[d.doc_id].text
    assert n and sum(len(r.entities) for r in new.values()) == n


# ---------------------------------------------------------------- licences


def test_licences_are_inherited_from_the_nearest_folder(spark):
    rows = [
        ("a/LICENSE", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software"),
        ("a/b/x.py", "import os"), ("a/b/c/LICENSE", "Apache License Version 2.0, January 2004"), ("a/b/c/d/y.py", None),
        ("a/b/z.py", "def main with many words of code that does something for its users\nLicensed under CC BY-NC 4.0.\nmore"), ("e/w.py", "no rights told"), (None, "Released under the MIT License."), ("top", ""),
    ]
    out = {r.path: (r.licence, r.origin) for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert out["a/b/x.py"] == ("MIT", "inherited") and out["a/b/c/d/y.py"] == ("Apache-2.0", "inherited")
    assert out["a/b/z.py"] == ("CC-BY-NC-4.0", "header") and out["a/LICENSE"] == ("MIT", "licence file")
    assert out["e/w.py"] == out["top"] == out[None] == (None, None)


MIT_BODY = "MIT License\n\nCopyright (c) 2020 Some One\n\n" + next(t for n, t in licenses._TEXTS if n == "MIT").replace(", ", ",\n")
BSD_BODY = "Copyright 2019, A Company\nAll rights reserved.\n\n" + licenses._BSD_START.replace("following", "\nfollowing") + "\n\n" + licenses._BSD_THIRD + "\n\n" + licenses._BSD_END


def test_licence_texts_and_spdx_lines(spark):
    texts = {
        "a/LICENSE": MIT_BODY, "a/x": "code", "b/LICENSE": BSD_BODY, "b/c/x": "code", "c/x": "# SPDX-License-Identifier: MIT\ncode", "d/x": "// SPDX-License-Identifier: Apache-2.0\nint x;",
        "e/x": "# SPDX-License-Identifier: NoSuch-9.9\nx", "f/COPYING": "GNU GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007\n\n" + "Everyone may copy this text. " * 9, "f/y": "z", "g/x": "the license of a thing", "h/x": "# Copyright\n# " + dict(licenses._TEXTS)["Apache-2.0"].replace(". ", ".\n# ") + "\n\nint y = 3;\n" * 9,
    }
    files = spark.createDataFrame([(k, t) for k, t in texts.items()], "path string, text string")
    found = {r.path: (r.licence, r.origin) for r in licenses.scan(files).collect()}
    assert found == {
        "a/LICENSE": ("MIT", "licence file"), "a/x": ("MIT", "inherited"), "b/LICENSE": ("BSD-3-Clause", "licence file"), "b/c/x": ("BSD-3-Clause", "inherited"), "c/x": ("MIT", found["c/x"][1]),
        "d/x": ("Apache-2.0", found["d/x"][1]), "e/x": (None, None), "f/COPYING": ("GPL-3.0", "licence file"), "f/y": ("GPL-3.0", "inherited"), "g/x": (None, None), "h/x": ("Apache-2.0", found["h/x"][1]),
    }


# ---------------------------------------------------------------- quality


def test_attention_gradient():
    r = np.random.default_rng(1)
    bags = [r.normal(size=(n, quality.DIM)).astype(np.float32) for n in (1, 3, 5)]
    model, x, count, y = quality.Model(), np.concatenate(bags), np.array([1, 3, 5]), np.array([1, 0, 1], np.float32)
    g = model.gradients(x, count, y)
    for name, grad in g.items():
        k = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        loss = []
        for d in (-1e-2, 1e-2):
            model.p[name][k] += d
            p = np.clip(model.score(x, count), 1e-9, 1 - 1e-9)
            loss.append(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())
            model.p[name][k] -= d
        assert abs((loss[1] - loss[0]) / 2e-2 - grad[k]) < 2e-2 * max(1, abs(grad[k]))
    assert np.allclose(np.add.reduceat(model.attention(x, count), [0, 1, 4]), 1)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op1_quality_attention(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(rows) > 50 and sum(r.predicted == r.quality for r in rows) >= 0.97 * len(rows)


# ---------------------------------------------------------------- oracles


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, sf, name):
    import duckdb

    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = db.execute(queries.ORACLES[name]).df()
    got = queries.QUERIES[name](spark, sf).toPandas()[list(want.columns)]
    text = lambda f: sorted(map(str, f.astype(object).where(f.notna(), None).itertuples(index=False, name=None)))
    assert text(want) == text(got)
