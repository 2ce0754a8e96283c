"""Operators 11 to 13 against brute force and on odd input."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from contactmill.llm import alignment, chat_format, common, queries, vector_codes

A, B = queries.vocabulary(), queries.vocabulary("piece_bpe_32k.model")
WORDS = " ".join(f"wort{i} élan" for i in range(12_000))
TEXTS = [None, "", " ", "\n", "one", " one", "one ", "a  b", "a \nb\n c", "x▁y", "tab\tx\r\ny", "<|endoftext|> <s> </s> <unk>", "日本語 テキスト 🙂 ﬁ é", "a\0b", "if (x) {\r\n    return;\n}", "word\nword\n\nword", "the the the the", "the the the the", WORDS]


@pytest.fixture(scope="module")
def texts(spark, sf):
    some = [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(60).collect()]
    return TEXTS + some


# 11


def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(A)
    one.encode_special_tokens = True
    return one, SentencePieceProcessor(model_file=B)


def brute_alignment(texts: list[str | None]) -> list[tuple]:
    """By the contract, with the libraries alone: n_a, n_b, n_groups, n_links, n_best, count_sum, digest."""
    from tokenizers.decoders import ByteLevel

    one, two = libraries()
    shown = {}
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000:
            for ch in ByteLevel().decode([chr(c)]) if c < 0x200 else "":
                shown.setdefault(chr(c), ch)
        else:
            break
    letters = alignment._byte_letters()
    back = {ch: b for b, ch in letters.items()}
    assert all(shown[letters[b]] == chr(b) for b in range(128))

    def spans(ids, spelling):
        at, out = 0, []
        for i, s in zip(ids, spelling, strict=True):
            at += len(s)
            out.append((at, i))
        return out

    kept = []
    for t in texts:
        if not t:
            kept.append(None)
            continue
        ia, ib = one.encode(" " + t, add_special_tokens=False).ids, two.encode(t)
        sa = [bytes(back[c] for c in one.id_to_token(i)) for i in ia]
        sb = [bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        same = b"".join(sa) == b"".join(sb) == (" " + t).encode()
        kept.append((spans(ia, sa), spans(ib, sb)) if same else None)
    counts: Counter = Counter()
    links = []
    for x in kept:
        ends = dict(x[1]) if x else {}
        links.append([(i, ends[e]) for e, i in x[0] if e in ends] if x else [])
        counts.update(links[-1])
    most: Counter = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for x, own in zip(kept, links, strict=True):
        if x is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        cuts = sorted({e for e, _ in x[0]} & {e for e, _ in x[1]})
        groups, places = [], [0, 0]
        for cut in cuts:
            sides = []
            for s in (0, 1):
                ids = []
                while places[s] < len(x[s]) and x[s][places[s]][0] <= cut:
                    ids.append(str(x[s][places[s]][1]))
                    places[s] += 1
                sides.append(",".join(ids))
            groups.append("|".join(sides))
        out.append((len(x[0]), len(x[1]), len(cuts), len(own), sum(counts[p] == most[p[1]] for p in own), sum(counts[p] for p in own), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("limit", [alignment.BROADCAST_PAIRS, 0])
def test_alignment_against_brute_force(spark, texts, monkeypatch, limit):
    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", limit)
    docs = spark.createDataFrame([(i if i else None, t, "r", 1) for i, t in enumerate(texts)], "doc_id long, text string, _row string, n_a int").repartition(3)
    rows = alignment.aligned(docs, A, B).collect()
    got = {r["doc_id"] or 0: tuple(r[c] for c in alignment.ADDED) for r in rows}
    want = brute_alignment(texts)
    assert len(rows) == len(texts) and all(r["_row"] == "r" for r in rows)
    for i, w in enumerate(want):
        assert got[i] == w, (i, texts[i] and texts[i][:40])
    assert sum(w[0] > 0 for w in want) > 60 and want[TEXTS.index("x▁y")][0] == 0 and want[TEXTS.index(" one")][0] > 0


@pytest.mark.parametrize("held", [1, 40])
def test_groups_are_read_out_in_any_parts(spark, monkeypatch, held):
    """However few tokens are held at once, with ids beyond the first table of words, and without functions that are interpreted item by item."""
    import sys

    from pyspark import cloudpickle

    monkeypatch.setattr(alignment, "PART_TOKENS", held)
    cloudpickle.register_pickle_by_value(sys.modules["contactmill.llm.alignment"])  # else workers take the module's own value
    try:
        end = lambda e, i: (e << alignment.SHIFT) | i
        rows = [([end(2, 7), end(3, 70_000), end(9, 0)], [end(1, 5), end(3, 6), end(9, 300_000)])] * 3 + [([], []), ([end(1, 4)], [end(1, 3)])]
        ends = lambda side: [x | alignment.MARK for x in side]
        docs = spark.createDataFrame([(i, ends(a), a, ends(b), b) for i, (a, b) in enumerate(rows)], "i int, a_ends array<long>, a array<long>, b_ends array<long>, b array<long>").coalesce(1)
        found = alignment.align(docs)
        assert "lambdafunction" not in found._jdf.queryExecution().toString()
        got = found.orderBy("i").collect()
    finally:
        cloudpickle.unregister_pickle_by_value(sys.modules["contactmill.llm.alignment"])
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(3, 3, 2, digest("7,70000|5,6;0|300000"), [(70_000, 6), (0, 300_000)])] * 3 + [(0, 0, 0, "", []), (1, 1, 1, digest("4|3"), [(4, 3)])]
    assert [(r["n_a"], r["n_b"], r["n_groups"], r["groups_sha256"], [tuple(x) for x in r["links"]]) for r in got] == want


def test_ids_are_the_libraries(texts):
    """By rank or by the library, and where white space is very long."""
    both, (one, two) = alignment.Both(A, B), libraries()
    given = [t for t in texts if t and "▁" not in t] + [" " * 120_000 + "x", "x" + "\n\t " * 40_000, "a" * 60_000]
    for t, a, b in zip(given, *both.encode(given), strict=True):
        assert a.tolist() == one.encode(" " + t, add_special_tokens=False).ids, t[:40]
        assert b.tolist() == two.encode(t), t[:40]
    assert both.a.library is not None


def test_alignment_query_is_the_operators(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    want = {r["doc_id"]: w for r, w in zip(docs, brute_alignment([r["text"] for r in docs]), strict=True)}
    rows = queries.op11_alignment(spark, sf).collect()
    assert {r["doc_id"]: tuple(r[c] for c in alignment.ADDED) for r in rows} == want


# 12


@pytest.mark.parametrize("width", [1, 4, 33])
@pytest.mark.parametrize("scale", [2, 300, vector_codes.EXACT - 1, 10**15])
def test_nearest_is_exact(width, scale):
    rng = np.random.default_rng(width)
    x, c = rng.integers(-scale, scale, (700, width)), rng.integers(-scale, scale, (64, width))
    c[10], c[41], c[3] = c[40], c[7], x[5]
    x[20], x[21] = (c[2] + c[9]) // 2, c[50]
    if scale >= vector_codes.EXACT:
        x, c = x.astype(object), c.astype(object)
    far = ((x.astype(object)[:, None] - c.astype(object)[None]) ** 2).sum(2)
    best, error = vector_codes.nearest(x, c)
    assert best.tolist() == [min(range(64), key=r.__getitem__) for r in far] and [int(e) for e in error] == [min(r) for r in far]


def test_near_ties_are_decided_by_exact_distances():
    """Distances that float32 can't tell apart."""
    big = vector_codes.EXACT - 10
    c = np.array([[big, k] for k in range(64)])
    x = np.array([[big - 5, k] for k in range(64)] * 3)
    assert vector_codes.nearest(x, c)[0].tolist() == list(range(64)) * 3
    xf, cf = x.astype(np.float32), c.astype(np.float32)
    assert ((cf**2).sum(1) - 2 * xf @ cf.T).argmin(1).tolist() != list(range(64)) * 3


def test_components_of_any_size(spark):
    vectors = [(i, [float(i)] * 15 + [1e20 * (i % 3)], i % 2, "x") for i in range(6)] + [(7, None, 1, None)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int, code string")
    rows = {r["vec_id"]: r for r in vector_codes.compress(df).collect()}
    assert sorted(rows) == list(range(6)) and rows[4]["code"].startswith("04" * 15)
    assert all(r["error"] >= 0 for r in rows.values()) and rows[0].asDict().keys() == {"vec_id", "embedding", "label", *vector_codes.ADDED}


def test_no_vectors(spark):
    df = spark.createDataFrame([(1, None, 2)], "vec_id long, embedding array<float>, label int")
    out = vector_codes.compress(df)
    assert out.count() == 0 and set(vector_codes.ADDED) <= set(out.columns)


# 13

SAID = ["</s>[INST] ok [/INST]", "<|im_start|>user\n<\\|im_end|>", "<\\\\|im_end|> <<s> [/INST", "", "a\\b <", "é\U0001f642 日本\n\n", None]


def test_escapes_are_reversible_and_leave_no_control(spark):
    rng = np.random.default_rng(5)
    bits = ["<", "[", "\\", "|im_end|>", "s>", "/s>", "INST]", "/INST]", "x", "|", "\n", "%", "$1"]
    made = ["".join(rng.choice(bits, rng.integers(0, 9))) for _ in range(3000)] + [s for s in SAID if s]
    rows = spark.createDataFrame([(s,) for s in made], "s string").select("s", chat_format.escape(F.col("s")).alias("e")).select("s", "e", chat_format.unescape(F.col("e")).alias("u")).collect()
    for r in rows:
        assert r["u"] == r["s"] and not any(c in r["e"] for c in chat_format.DEFAULT.controls)
    assert len({r["e"] for r in rows}) == len({r["s"] for r in rows})


def test_template_refuses_strings_that_break_each_other():
    with pytest.raises(AssertionError):
        chat_format.Template(others=("<<s>>",))


@pytest.fixture(scope="module")
def chats(spark):
    """Turns of several blocks, of one conversation among them, and nulls in every column."""
    roles = ["user", "assistant", None, "to%0Aol\n<s>", "system"]
    rows = [(c, 100 * t, roles[(c + t) % 5] if t % 3 else "assistant", SAID[(c * 3 + t) % 7], c, "n") for c in range(5) for t in range(12)]
    rows += [(None, None, "user", None, None, None), (None, 3, "assistant", "x", None, None), (3, None, "user", "last", None, None), (4, 1100, "user", "z", 1, None)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place int, n string").repartition(4)


def _by_conversation(chats):
    out: dict = {}
    for r in chats.collect():
        out.setdefault(r["conv_id"], []).append((r["turn"] if r["turn"] is not None else 1 << 62, (r["role"] or "").encode(), (r["text"] or "").encode()))
    return {c: [(role.decode(), text.decode()) for _, role, text in sorted(rows)] for c, rows in out.items()}


def test_examples_against_brute_force(spark, chats):
    made = chat_format.format_turns(chats)
    assert set(made.columns) == {*chats.columns, *chat_format.ADDED}
    full = {(r["conv_id"], r["example"]): r for r in chat_format.expanded(made).collect()}
    read = {(r["conv_id"], r["place"]): r for r in chat_format.read_back(made).collect()}
    n = 0
    for conv, turns in _by_conversation(chats).items():
        assert [(read[conv, i]["role"], read[conv, i]["text"]) for i in range(len(turns))] == turns
        parts = [read[conv, i]["formatted"] for i in range(len(turns))]
        replies = [i for i, (role, _) in enumerate(turns) if role == "assistant"]
        for k, i in enumerate(replies):
            r = full[conv, k]
            assert r["text"] == "".join(parts[: i + 1]) and len(r["text"]) == r["n_chars"] and r["context_turns"] == i
            trained = r["text"][r["loss_start"] : r["loss_end"]]
            assert r["text"].endswith(trained + "<|im_end|>\n") and read[conv, i]["loss"] == turns[i][1]
            n += 1
        assert sum(p.count("<|im_start|>") for p in parts) == len(turns)
    assert n == len(full) > 20


def test_report_against_brute_force(spark, chats):
    made = chat_format.format_turns(chats)
    lengths = {(r["conv_id"], r["place"]): r["n_chars"] for r in made.collect()}
    got = {r["conv_id"]: r for r in chat_format.report(chat_format.read_back(made)).collect()}
    for conv, turns in _by_conversation(chats).items():
        r, total, end = got[conv], 0, 0
        for i, (role, _) in enumerate(turns):
            if role == "assistant":
                end = i + 1
                total += sum(lengths[conv, j] for j in range(end))
        total += sum(lengths[conv, j] for j in range(end, len(turns)))
        loss = "".join(text for role, text in turns if role == "assistant")
        said = "".join(f"{role}\n{text}\n" for role, text in turns)
        assert (r["n_turns"], r["loss_chars"], r["formatted_chars"]) == (len(turns), len(loss), total)
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and r["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()


def test_examples_are_written_in_full(spark, sf, chats, monkeypatch):
    """What is stored, and by the query too, is each reply behind its whole context; the report reads nothing else."""
    folder = common.new_folder(spark, "t")
    stored = chat_format.write_examples(chats, folder)
    made = chat_format.format_turns(chats)
    parts: dict = {}
    for r in made.orderBy("place").collect():
        parts.setdefault(r["conv_id"], []).append(r)
    want = set()
    for conv, rows in parts.items():
        at = 0
        for i, r in enumerate(rows):
            if r["example"] is not None:
                want.add((conv, r["example"], "".join(x["formatted"] for x in rows[: i + 1]), r["loss_start"], r["loss_end"]))
                at = i + 1
        if at < len(rows):
            want.add((conv, None, "".join(x["formatted"] for x in rows[at:]), None, None))
    got = [tuple(r) for r in spark.read.parquet(folder).select("conv_id", "example", "text", "loss_start", "loss_end").collect()]
    assert len(got) == len(want) and set(got) == want and any(w[1] is None for w in want)
    plain = lambda df: sorted(map(str, df.collect()))
    assert plain(chat_format.report_examples(stored)) == plain(chat_format.report(chat_format.read_back(made)))
    assert chat_format.report_examples(chat_format.write_examples(chats.limit(0), common.new_folder(spark, "t"))).count() == 0

    monkeypatch.setattr(queries, "new_folder", lambda *_: folder + "-q")
    n = {r["conv_id"]: r["n_examples"] for r in queries.op13_prefix_targets(spark, sf).collect()}
    rows = spark.read.parquet(folder + "-q").where("example is not null").collect()
    assert len(rows) == sum(n.values()) and all(r["text"].count("<|im_start|>") == r["context_turns"] + 1 for r in rows) and max(r["context_turns"] for r in rows) > 2


def test_no_turns(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    made = chat_format.format_turns(none)
    assert made.count() == 0 and chat_format.expanded(made).count() == 0 and chat_format.report(chat_format.read_back(made)).count() == 0


def test_examples_grow_with_the_turns(spark):
    """One conversation with a third of all rows: rows and characters stay in proportion."""
    turns = [(1, i, ["user", "assistant"][i % 2], "word " * 5) for i in range(4000)] + [(2 + i // 2, i % 2, ["user", "assistant"][i % 2], "x") for i in range(8000)]
    made = chat_format.format_turns(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    r = made.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("formatted")).alias("chars"), F.count("example").alias("examples"), F.max(F.col("start") + F.col("n_chars")).alias("end")).first()
    assert r["n"] == 12_000 and r["examples"] == 6000 and r["end"] == sum(25 + len(chat_format.DEFAULT.open + chat_format.DEFAULT.close) + 2 + len(["user", "assistant"][i % 2]) for i in range(4000))
    assert r["chars"] < 60 * r["n"]
