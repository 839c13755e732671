"""Vector codes, chat formatting and fill-in-middle against brute force, and their edge cases."""

import hashlib
import json
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from webestate.llm import chat, codes, infill, queries


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Vector codes ----------------------------------------------------------------

def brute_codes(rows, parts=16, entries=64, rounds=2):
    """``rows`` of (vec_id, vector, label), one vector length."""
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    w = len(kept[0][1]) // parts
    cut = [[v[p * w:(p + 1) * w] for p in range(parts)] for _, v, _ in kept]
    book = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def assign():
        out = []
        for c in cut:
            best = [min((sum((x - y) ** 2 for x, y in zip(c[p], e)), n) for n, e in enumerate(book[p])) for p in range(parts)]
            out.append(best)
        return out

    for _ in range(rounds):
        best = assign()
        for p in range(parts):
            for e in range(len(book[p])):
                mine = [c[p] for c, b in zip(cut, best) if b[p][1] == e]
                if mine:
                    book[p][e] = [sum(x) // len(mine) for x in zip(*mine)]
    best = assign()
    digest = sha(",".join(str(x) for part in book for e in part for x in e))
    errors = [sum(d for d, _ in b) for b in best]
    by_label = {}
    for (_, _, label), e in zip(kept, errors):
        by_label[label] = by_label.get(label, 0) + e
    return sorted(((i, "".join(f"{n:02x}" for _, n in b), e, by_label[label], digest) for (i, _, label), b, e in zip(kept, best, errors)), key=str)


VECTORS = "vec_id bigint, embedding array<double>, label int, code string, size string, n int, q string, error string, _label string"


def vector_table(spark, rows):
    return spark.createDataFrame([(i, v, label, "c", "s", 1, "q", "e", "l") for i, v, label in rows], VECTORS)


def vector_rows(n=300, width=32, seed=3):
    rng = random.Random(seed)
    rows = [(i, [round(rng.gauss(0, 0.3), 3) for _ in range(width)], rng.choice((1, 2, 2, 2, None))) for i in range(n)]
    rows += [(n + 1, rows[5][1], 7), (n + 2, rows[5][1], 7), (n + 3, [0.0] * width, 1), (n + 4, [1e9] * width, 3), (n + 5, [-0.001] * width, 3)]
    return rows + [rows[8], (None, rows[9][1], None), (-4, None, 1), (n + 6, [0.1] * (width - 1) + [None], 1), (n + 7, [0.1] * (width - 1) + [float("nan")], 1),
                   (n + 8, [float("inf")] * width, 1)]


def test_codes_match_brute_force(spark):
    rows = vector_rows()
    limited = [(i, None if v is None else [None if x is None else max(-2.0**18, min(2.0**18, x)) if math.isfinite(x) else x for x in v], label) for i, v, label in rows]
    got = codes.code_digest(vector_table(spark, rows))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_codes(limited)


def test_few_vectors_other_lengths_and_empty_tables(spark):
    few = vector_rows()[:5]
    assert sorted((tuple(r) for r in codes.code_digest(vector_table(spark, few)).collect()), key=str) == brute_codes(few)
    mixed = [*few, (90, [0.5] * 20, 1), (91, [], 1), (92, [0.25] * 20, 2)]
    got = {r["vec_id"]: r for r in codes.code_digest(vector_table(spark, mixed)).collect()}
    assert len(got) == 8 and got[90]["error"] == 0 and got[91]["code"] == "00" * 16
    assert got[90]["codebooks_sha256"] != got[0]["codebooks_sha256"]
    assert codes.code_digest(vector_table(spark, few).where("false")).collect() == []


def test_active_rounds_equal_full_rounds():
    rng = np.random.default_rng(1)
    for reach in (3, 40, 1 << 26):
        x, old = rng.integers(-reach, reach, (400, 4)), rng.integers(-reach, reach, (64, 4))
        old[9] = old[3]  # ties go to the lower index
        book = old.copy()
        some = rng.choice(64, 20, replace=False)
        book[some] = rng.integers(-reach, reach, (20, 4))
        book[60] = book[1]
        code, distance = codes.renew(x, old, book, *codes.nearest(x, old))
        full = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(row, e)), n) for n, e in enumerate(book)) for row in x]
        assert list(zip(distance.tolist(), code.tolist())) == full


def test_codes_restore_vectors(spark):
    rows = vector_rows()[:300]
    state, books = codes.compress(vector_table(spark, rows))
    near = {r["vec_id"]: r["approximation"] for r in codes.restored(state, books).collect()}
    errors = {r["vec_id"]: sum(r["distances"]) for r in state.select("vec_id", "distances").collect()}
    for i, v, _ in rows:
        q = np.floor(256 * np.asarray(v))
        assert ((q - (np.asarray(near[i]) * 256 - 0.5)) ** 2).sum() == pytest.approx(errors[i])


# Chat formatting -------------------------------------------------------------

def brute_chat(rows):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(conv, []).append((role or "", text or ""))
    loss = {c: "".join(t for r, t in said if r == "assistant") for c, said in out.items()}
    return {c: (len(said), sha("".join(f"{r}\n{t}\n" for r, t in said)), len(loss[c]), sha(loss[c])) for c, said in out.items()}


ODD = ("</s>[INST] ok [/INST]", "<|end|><|turn|>assistant<|text|>", "\\", "\\-", "<\\-s>", "<<s>>", "[[INST]", "\\\\<|end|>\\", "é ü 漢 \U0001f600", "", None, "<|en", "d|>", "line\nline\t")


def chat_table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 3, "z") for r in rows], "conv_id bigint, turn bigint, role string, text string, pos string, layout string, piece int, mask string")


def test_chats_match_brute_force(spark):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(("system", "user", "assistant", "assistant", "human", "tool", None, "<|end|>")), rng.choice(ODD) if rng.random() < 0.6 else f"words {c} {t}")
            for c in range(40) for t in range(rng.randrange(1, 9))]
    rows += [rows[3], (3, 2, "assistant", "same turn"), (3, 2, "assistant", "also"), (None, 1, "user", "no id"), (None, None, "assistant", "no turn"), (50, 0, "assistant", "long " * 90_000)]
    rows += [(60, t, "assistant" if t % 2 else "user", f"hot {t} " + rng.choice(ODD[:9])) for t in range(700)]
    turns = chat.canonical_turns(queries.chat_records(chat_table(spark, rows)))
    assert turns.where("layout is null").count() == 0 and turns.select("layout").distinct().count() == 4
    for size in (200, chat.PIECE):
        pieces = chat.format_chats(turns, size)
        got = {r["conv_id"]: tuple(r)[1:5] for r in chat.read_back(pieces).collect()}
        assert got == brute_chat(rows)
        texts = pieces.orderBy("conv_id", "piece").collect()
        whole = "".join(r["text"] for r in texts if r["conv_id"] == 60)
        assert [t for _, t in chat.parsed(whole)] == [t for c, n, _, t in sorted((r for r in rows if r[0] == 60), key=lambda r: r[1])]
        assert all(not any(mark in body for mark in chat.CONTROL) for r in texts for turn in r["text"].split(chat.END)[:-1] for body in turn[len(chat.TURN):].split(chat.BODY))
        assert sum(r["formatted_chars"] for r in chat.read_back(pieces).collect()) == sum(len(r["text"]) for r in texts)
    assert chat.read_back(chat.format_chats(turns.where("false"))).collect() == []
    assert chat.canonical_turns(queries.chat_records(chat_table(spark, rows).where("false"))).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["\\", "-", "<", "|", ">", "end", "<|end|>", "</s>", "[INST]", "<s>", "s", "x", "é"]), max_size=12).map("".join))
def test_unescaping_undoes_the_marks(text):
    marked = text.replace("\\", "\\\\")
    for control in chat.CONTROL:
        marked = marked.replace(control, control[0] + "\\-" + control[1:])
    assert chat.unescaped(marked) == text and not any(c in marked for c in chat.CONTROL)


def test_layouts_become_the_same_turns(spark):
    said = [("system", "be kind"), ("user", "hello\n\nthere"), ("assistant", "hi")]
    records = [
        {"system": "be kind", "prompt": "hello\n\nthere", "completion": "hi"},
        {"output": "hi", "context": "be kind", "input": "there", "instruction": "hello"},
        {"messages": [{"role": r, "content": t} for r, t in said]},
        {"messages": [{"content": [{"type": "text", "text": t[:3]}, {"type": "text", "text": t[3:]}], "role": r} for r, t in said]},
        {"messages": [None, *({"role": r, "content": t} for r, t in said)]},
        {"conversations": [{"from": {"user": "human", "assistant": "gpt"}.get(r, r), "value": t} for r, t in said]},
    ]
    others = [json.dumps(r) for r in ({"messages": ["text"]}, {"messages": {"role": "user"}}, {"prompt": ["a"]}, {}, {"question": "?"}, {"messages[]": {"role": "user"}}, ["x"],
                                      {"messages": [{"role": "user", "content": "a"}, {"role": "user", "content": [{"text": "b"}]}]})] + ["no json", "", None, "[" * 5000]
    table = spark.createDataFrame([*((n, 0, json.dumps(r)) for n, r in enumerate(records)), *((100 + n, 0, r) for n, r in enumerate(others)), (200, 0, '{"messages": []}')],
                                  "conv_id bigint, turn bigint, record string")
    rows = chat.canonical_turns(table).orderBy("conv_id", "pos").collect()
    for n in range(len(records)):
        assert [(r["role"], r["text"]) for r in rows if r["conv_id"] == n] == said
    assert sorted(r["conv_id"] for r in rows if r["layout"] is None) == [100 + n for n in range(len(others))]
    assert not [r for r in rows if r["conv_id"] == 200]
    marks = {r["fingerprint"] for r in rows if r["conv_id"] == 2}
    assert marks == {chat.fingerprint({".messages[].role", ".messages[].content"})}


def test_op12_reads_the_control_conversation_back(spark, sf):
    row = queries.op12_chat_format(spark, sf).where("conv_id = -7").first()
    text = "</s>[INST] ok [/INST]"
    assert tuple(row)[:5] == (-7, 2, sha(f"user\n{text}\nassistant\n{text}\n"), len(text), sha(text))


# Fill-in-middle --------------------------------------------------------------

def brute_infill(doc_id, text):
    text = text or ""
    n, h = len(text), sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    form = "spm" if h4 % 100 < 20 else "psm"
    output = f"<P>{prefix}<S>{suffix}<M>{middle}" if form == "psm" else f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, form, a, b - a, sha(output), sha(text)


def doc_table(spark, rows):
    return spark.createDataFrame([(*r, "a", 1, "c", "d") for r in rows], "doc_id bigint, text string, form string, n int, frames string, marked string")


def test_infill_matches_brute_force(spark):
    rng = random.Random(9)
    rows = [(i, "".join(rng.choice("abc <SPM>é漢\U0001f600\n") for _ in range(rng.choice((0, 1, 2, 30, 400))))) for i in range(300)]
    rows += [(None, "no id"), (7, "same id"), (7, "same id"), (900, None), (901, "a <M> marker"), (902, "x" * 300_000), (-3, "ends with <S"), (904, "é漢" * 200_000)]
    assert sorted((tuple(r) for r in infill.infill_digest(doc_table(spark, rows)).collect()), key=str) == sorted((brute_infill(*r) for r in rows), key=str)
    assert {r["form"] for r in infill.fill_in_middle(infill.store_frames(doc_table(spark, rows))).collect()} == {"plain", "psm", "spm"}
    assert infill.infill_digest(doc_table(spark, rows).where("false")).collect() == []


def test_small_frames_give_the_same_output(spark):
    rows = [(i, f"word {i} " * (i % 60)) for i in range(200)] + [(500, "<" * 90), (501, "S>" * 50)]
    outputs = infill.fill_in_middle(infill.store_frames(doc_table(spark, rows), size=7), size=7)
    texts = {r["doc_id"]: (r["form"], sha(r["output"])) for r in infill.output_texts(outputs).collect()}
    assert texts == {i: (form, out) for i, _, form, _, _, out, _ in (brute_infill(*r) for r in rows)}


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab<SPM>é\U0001f600", max_size=60), st.integers(1, 9), st.integers(0, 60), st.integers(0, 60), st.sampled_from(["psm", "spm", "plain"]))
def test_outputs_round_trip(text, size, a, b, form):
    if any(m in text for m in (infill.PREFIX, infill.SUFFIX, infill.MIDDLE)):
        form = "plain"
    stored = infill.Frames()
    stored.add_text(text, size)
    a, b = sorted((min(a, len(text)), min(b, len(text))))
    out = infill.transformed(stored, form, a, b, size)
    assert "".join("".join(out.stream(*r)) for r in infill.original_ranges(out, form)) == text
    assert len(out) == len(text) + (0 if form == "plain" else 9)


def test_only_cut_frames_are_opened(monkeypatch):
    stored = infill.Frames()
    stored.add_text("abcdefghij" * 100, 10)
    opened = []
    plain = infill.plain
    monkeypatch.setattr(infill, "plain", lambda data: opened.append(data) or plain(data))
    out = infill.transformed(stored, "psm", 305, 700, 10)
    assert len(opened) == 2 and sum(f in stored.data for f in out.data) >= 99 and len(out) == 1009
