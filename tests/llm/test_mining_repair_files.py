"""Hard negatives, conversation repair and token files against brute force, the tokenizer itself and odd rows."""

import hashlib
import math
import random
import zlib
from array import array

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomwork.llm import chat_repair, hard_negatives, token_files
from loomwork.llm import pieces as pieces_of
from loomwork.llm.common import pick

# --- hard negatives ---


def mined(rows):
    """By all pairs, row by row."""
    rows = [(n, i, [math.floor(256 * x) for x in v], label) for n, (i, v, label) in enumerate(rows) if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    last = lambda i: math.inf if i is None else i
    out = []
    for n, i, v, label in rows:
        if i is None or i % 100:
            continue
        near = sorted((-dot(v, w), last(j), m) for m, j, w, other in rows if m != n and other == label)[:5]
        for s, j, _ in near:
            far = sorted((-dot(v, w), last(k), m) for m, k, w, other in rows if other != label and 30 * -s <= 100 * dot(v, w) <= 90 * -s)[:10]
            out += [(i, j, r, k, -s, -t) for r, (t, k, _) in enumerate(far, 1)]
    return sorted((tuple(None if y == math.inf else y for y in x) for x in out), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


VECTORS = "vec_id long, embedding array<double>, label int"


def test_hard_negatives(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=6) * rng.choice([0.05, 0.3, 1.0, 4.0])).tolist(), int(rng.integers(3))) for i in range(900)]
    rows += [(100 * k, rows[k][1], 1) for k in range(3)]  # ids that are there already
    rows += [(1000 + k, [0.5] * 6, k % 2) for k in range(300)] + [(2000, [0.5] * 6, 1)] * 3  # one vector, many times
    rows += [(3000, None, 1), (3001, [None, 1.0], 1), (3002, [math.nan, 1.0], 1), (3003, [math.inf, 1.0], 2), (3004, [0.1] * 6, None), (3100, [], 0), (3200, [1.0, 2.0], 0), (3300, [1.0] * 9, 2), (None, [1.0] * 6, 2)]
    df = spark.createDataFrame(rows, VECTORS).select("*", F.lit(1).alias("VEC_ID"), F.lit(1).alias("row"), F.lit(2).alias("norm"))
    got = rows_of(hard_negatives.mine(df))
    assert got == mined(rows) and len(got) > 500


def test_hard_negatives_in_many_blocks(spark, monkeypatch):
    for name, value in (("BUCKET", 16), ("SLICE_ROWS", 100), ("GROUP", 4)):
        monkeypatch.setattr(hard_negatives, name, value)
    rng = np.random.default_rng(4)
    rows = [(5 * i, (rng.normal(size=4) * (i % 7)).tolist(), i % 3) for i in range(700)]
    assert rows_of(hard_negatives.mine(spark.createDataFrame(rows, VECTORS))) == mined(rows)


def test_hard_negatives_of_large_numbers_and_none(spark):
    rows = [(100, [3e6, -2e6], 0), (1, [2.5e6, 1e6], 0), (2, [1e6, 1e5], 1), (3, [2e6, 2e6], 1), (200, [1e-20, -1e-20], 1)]
    df = spark.createDataFrame(rows, VECTORS)
    assert rows_of(hard_negatives.mine(df)) == mined(rows)
    assert hard_negatives.mine(df.where("false")).count() == 0
    assert hard_negatives.mine(df.where("vec_id = 100")).count() == 0


def test_bounds_leave_out_buckets(monkeypatch):
    asked = []
    real = hard_negatives.products
    monkeypatch.setattr(hard_negatives, "products", lambda a, at, b: asked.append(len(at)) or real(a, at, b))
    rng = np.random.default_rng(5)

    def block(ids, vectors, score=0):
        norms = np.sqrt((vectors**2).sum(1))
        longs = lambda x: np.asarray(x, np.int64).tobytes()
        return hard_negatives._Block({"ids": longs(ids), "rows": longs(ids), "labels": longs([0] * len(ids)), "scores": longs([score] * len(ids)), "norms": norms.tobytes(), "vectors": vectors.tobytes(), "n": len(ids), "width": vectors.shape[1]})

    large, small = np.floor(rng.normal(size=(50, 4)) * 10000), np.floor(rng.normal(size=(50, 4)) * 10)
    best = hard_negatives.best_positives(block([1000], large[:1]), [block(range(50), large), block(range(50, 100), small)])
    assert len(asked) == 1 and len(best.ids) == 5


# --- conversation repair ---


def edited(rows):
    """(cost, audit) by least cost and then least audit over all prefixes, state by state."""
    after, inserted = {"s": 1, "u": 2, "a": 3}, lambda s: "uuau"[s]

    def inserts(found):
        found = dict(found)
        for _ in range(3):
            for s, (c, a) in list(found.items()):
                to = after[inserted(s)]
                found[to] = min(found.get(to, (10**9, "")), (c + 5, a + "I"))
        return found

    found = {0: (0, "")}
    for r in rows:
        new = {}
        for s, (c, a) in inserts(found).items():
            moves = [(s, c + 2, "D")]
            if r != "x":
                more = 5 if r in "SUA!" else 0
                moves.append((after[inserted(s)], c + 1 + more, "R"))
                if r.lower() == inserted(s) or r.lower() == "s" and s == 0:
                    moves.append((after[r.lower()], c + more, "K"))
            for to, cost, edit in moves:
                new[to] = min(new.get(to, (10**9, "")), (cost, a + edit))
        found = new
    return min(v for s, v in inserts(found).items() if s in (0, 3))


@settings(max_examples=400, deadline=None)
@given(st.text("suaSUA?!xua", max_size=14))
def test_cheapest_edits(rows):
    assert chat_repair.cheapest(rows) == edited(rows)


def test_cheapest_edits_of_a_long_conversation():
    rng = random.Random(2)
    rows = "".join(rng.choice("suaSUA?!xuaua") for _ in range(3000))
    assert chat_repair.cheapest(rows) == edited(rows)


def repaired_rows(turns):
    """One conversation's result, from its rows after damage."""
    turns = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in turns), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, counts, signs, illegal = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, "", 0
    space = " \t\n\x0b\x0c\r"
    for k, (_, role, text) in enumerate(turns):
        fault = "blank" if not text.strip(space) else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(space)[-1] not in ".!?" else ""
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        sign = role[:1] if role[:1] in ("s", "u", "a") and role else "?"
        signs += "x" if fault in ("blank", "duplicate") else ("!" if sign == "?" else sign.upper()) if fault else sign
        illegal += k > 0 and turns[k - 1][1][:1] + role[:1] not in ("su", "ua", "au")
    cost, audit = edited(signs)
    out, state, at = [], 0, 0
    for edit in audit:
        role, text = ({"u": "user", "a": "assistant"}["uuau"[state]], "") if edit in "IR" else ("", "")
        if edit != "I":
            text, role = turns[at][2], role or turns[at][1]
            at += 1
        if edit != "D":
            out.append(f"{role}:{text}")
            state = {"s": 1, "u": 2, "a": 3}[role[0]]
    known = [t for t, _, _ in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


TURNS = "conv_id long, turn long, role string, text string"


def test_repair(spark):
    rng = random.Random(1)
    said = ["Yes.", "No!", "Why?", "cut off", "", " \t\n", None, "  end. \n", "é", "a ", "x." * 30_000]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "User"]
    rows = [(c if c else None, rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(said)) for c in range(60) for _ in range(rng.randint(1, 9))]
    rows += [(99, k, "user" if k % 2 == 0 else "assistant", f"Turn {k}.") for k in range(400)]
    df = spark.createDataFrame(rows, TURNS).select("*", F.lit(1).alias("TEXT"), F.lit(1).alias("place"), F.lit(0).alias("audit"))
    extra = spark.createDataFrame([(7777,), (99,)], "conv_id long")
    got = {r.conv_id: tuple(r)[1:] for r in chat_repair.repair(df, extra).collect()}
    want = {c: repaired_rows([r[1:] for r in rows if r[0] == c]) for c in {r[0] for r in rows}}
    assert got.pop(7777) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert got == want
    assert chat_repair.repair(df.where("false")).count() == 0


def test_damage(spark):
    rows = [(c, t, "assistant", "A. b! c?") for c in range(40) for t in range(5)] + [(None, None, None, None)]
    got = sorted(map(tuple, chat_repair.damaged(spark.createDataFrame(rows, TURNS)).collect()), key=str)
    want = []
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        text = "" if k == 1 else text.translate({ord(x): None for x in ".!?"}) if k == 2 else text
        want += [(c, t, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    assert got == sorted(want, key=str)


# --- token files ---

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def pieces():
    return pieces_of.PieceEncoder(BYTE_BPE)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from([*" \n\t\r　\x85\x00ab1'sZé—ßıÀ²,.😀", "  ", "\n\n", "'s", "'ll", "<|endoftext|>", "\x1c", "word", " word"]), max_size=12))
def test_pieces_are_what_the_tokenizer_gives(pieces, parts):
    text = "".join(parts)
    assert pieces.cut and pieces.encode(text) == pieces.encode(text) == array("H", pieces.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


DOCS = "doc_id long, text string"


def listed(rows, tokenizer):
    ids = lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
    return [(i, np.array(ids(t), "<u4").tobytes()) for i, t in rows]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_token_files(spark, tmp_path, pieces, name):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["word", "other\n", "Ünï", "x1y", "<|endoftext|>"]) for _ in range(rng.choice([0, 3, 900])))) for i in rng.sample(range(1000), 300)]
    rows += [(5000, None), (5001, ""), (5002, "end " * 40_000), (None, "no id"), (6000, "same"), (6000, "same"), (6000, "same")]
    df = spark.createDataFrame(rows, DOCS).repartition(5).select("*", F.lit(1).alias("TEXT"), F.lit(1).alias("row"))
    folder = f"file://{tmp_path}/t"
    token_files.write_tokens(df, public_tokenizers.path(name), folder, size=64, shard_bytes=30_000)
    got = sorted(token_files.read_tokens(spark, folder).collect(), key=lambda r: r.start)
    want = listed(sorted(rows, key=lambda r: (r[0] is not None, r[0])), pieces.tokenizer if name.startswith("byte") else pieces_of.PieceEncoder(public_tokenizers.path(name)).tokenizer)
    assert [(r.doc_id, bytes(r.ids)) for r in got] == want
    assert [r.start for r in got] == [sum(len(x) // 4 for _, x in want[:k]) for k in range(len(want))]
    assert all(r.n_tokens == len(x) // 4 and r.ids_crc32 == zlib.crc32(x) for r, (_, x) in zip(got, want, strict=True))
    # random access to the mapped files, without a copy
    flat, at = np.frombuffer(b"".join(x for _, x in want), "<u4"), 0
    files = sorted(p for p in (tmp_path / "t").glob("part-*") if p.stat().st_size)
    assert len(files) > 1
    for path in files:
        file = token_files.SequenceFile(pa.memory_map(str(path)).read_buffer())
        for i in range(len(file)):
            ids, mask = file.sequence(i)
            n = mask.true_count
            assert file.data.address <= ids.ctypes.data < file.data.address + file.data.size
            assert len(ids) == len(mask) == 64 and ids[:n].tolist() == flat[at : at + n].tolist() and not ids[n:].any()
            at += n
        assert pa.ipc.open_stream(pa.memory_map(str(path))).read_all().num_rows == len(file)
    assert at == len(flat)


def test_no_tokens(spark, tmp_path):
    token_files.write_tokens(spark.createDataFrame([], DOCS), BYTE_BPE, f"file://{tmp_path}/e")
    assert token_files.read_tokens(spark, f"file://{tmp_path}/e").count() == 0
    token_files.write_tokens(spark.createDataFrame([(1, None)], DOCS), BYTE_BPE, f"file://{tmp_path}/n")
    assert [(r.doc_id, r.start, r.n_tokens) for r in token_files.read_tokens(spark, f"file://{tmp_path}/n").collect()] == [(1, 0, 1)]
    broken = next(p for p in (tmp_path / "n").glob("part-*") if p.stat().st_size).read_bytes()
    with pytest.raises((ValueError, pa.ArrowInvalid)):
        token_files.SequenceFile(broken[:-200]).documents()


def test_columns_by_exact_name(spark):
    assert pick(spark.createDataFrame([(1, "a", 2)], "doc_id long, text string, TEXT long"), "text").columns == ["text"]
