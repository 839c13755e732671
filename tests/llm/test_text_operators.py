"""Text operators against brute force, and their edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from webestate.llm import decontam, langid, lines, mixing, near, passages, queries, secrets, suffixes

#: Extra columns with names that operators use inside.
SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, cell string, h1 string, mark string, rep string, size string, "
          "_id string, range string, salt int, class_id string, bands int, word string")
EXTRA = ("c", "h", "m", "r", "s", "i", "g", 1, "k", 2, "w")


def table(spark, rows):
    """``rows`` of (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(*r, *("en", "s")[len(r) - 2:], len(r[1] or ""), *EXTRA) if len(r) < 4 else (*r, len(r[1] or ""), *EXTRA) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="module")
def given(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    return rows, spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def invented(seed=4, n=60):
    """Texts with repeats, copies and edits."""
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("one two three four five six seven eight nine ten".split()) + str(rng.randrange(40)) for _ in range(60)) for _ in range(8)]
    rows = []
    for i in range(n):
        w = (rng.choice(pool) + " " + rng.choice(pool) if i % 3 else " ".join(f"w{rng.randrange(9000)}" for _ in range(80))).split()
        for _ in range(rng.choice((0, 0, 1, 3, 8))):
            w[rng.randrange(len(w))] = f"x{rng.randrange(1000)}"
        rows.append((i, rng.choice((" ", "  ", "\n")).join(w)))
    return [*rows, (n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "short text"), (n + 4, "short text"), (n + 5, "é" * 300 + " " + "aß " * 300), (n + 6, "a " * 900), (n + 7, "ab" * 700)]


def got(df, *names):
    return sorted(tuple(r[c] for c in names) for r in df.select(*names).collect())


def test_lines_match_brute_force(spark, given):
    shared = "  This LINE is shared by a number of documents, Ünicode kept  "
    rows = [(i, f"own line {i}\n{shared}\n\n{shared.upper() if i == 3 else shared}\nlast") for i in range(7)] + [(9, None), (10, ""), (11, "\n\n"), (12, "\t" + shared.strip() + "\r")]
    for rows in (rows, given[0], [*rows, rows[2], (None, shared), (2, "other text\n" + shared)]):
        expected = sorted(((i, n, g, brute.sha(k.encode())) for (i, _), (n, g, k) in zip(rows, brute.drop_lines(rows), strict=True)), key=str)
        assert sorted(map(tuple, lines.line_digest(table(spark, rows)).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()), key=str) == expected
        kept = lines.dedup_lines(table(spark, rows))
        assert kept.columns == table(spark, rows).columns
        assert sorted(str(r["text"] or "") for r in kept.collect()) == sorted(k for _, _, k in brute.drop_lines(rows))


def test_line_bitmaps_are_words_of_dropped_lines(spark):
    line = "x" * 50
    rows = [(i, "\n".join(["a"] * 70 + [line] + ["b"] * 100 + [line])) for i in range(5)]
    found = lines.line_bitmaps(table(spark, rows)).collect()
    assert sorted(r["doc_id"] for r in found) == [0, 1, 2, 3]
    assert all(r["dropped"] == {70 // 64: 1 << 70 % 64, 171 // 64: 1 << 171 % 64} and r["n_dropped"] == 2 for r in found)


def test_passages_match_brute_force(spark, given):
    for rows in (invented(), given[0]):
        expected = sorted((i, n, g, k.decode()) for (i, _), (n, g, k) in zip(rows, brute.drop_passages(rows), strict=True))
        assert got(passages.dedup_passages(table(spark, rows)), "doc_id", "n_words", "n_removed", "kept") == expected


def test_passages_of_unnamed_and_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(20))
    out = passages.dedup_passages(table(spark, [(None, text), (4, text), (4, text), (5, text)])).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in out) == [(0, 0), (4, 0), (4, 0), (5, 20)]


@pytest.mark.parametrize("span", [100, 400])
def test_suffixes_match_brute_force(spark, span):
    rows = [*invented(n=30), (200, None), (0, "z" * 450)]
    expected = sorted((i, n, g, s, k) for (i, _), (n, g, s, k) in zip(rows, brute.drop_strings([t for _, t in rows], span), strict=True))
    out = suffixes.dedup_suffixes(table(spark, rows), span=span)
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in out.collect()) == expected


def test_suffix_levels_merge_geometrically(spark):
    rows = table(spark, invented(n=20))
    index, parted = suffixes.SuffixIndex(), suffixes.c.cells(rows)[0]
    asks = parted.groupBy("cell").applyInArrow(lambda d: suffixes._ask_suffixes(d, 400, 4), suffixes.c.ASKS)
    sizes = []
    for b in range(5):
        index.add(asks.where(F.pmod("cell", F.lit(5)) == b))
        sizes.append([n for n, _ in index.levels])
    assert sizes == [[1], [1, 1], [2, 1], [2, 1, 1], [4, 1]]


def test_near_classes_match_brute_force(spark, given):
    for rows in (invented(), given[0]):
        expected = brute.near_classes(rows)
        assert dict(got(near.near_digest(table(spark, rows)), "doc_id", "class_id")) == expected
        assert sorted(r["doc_id"] for r in near.keep_one(table(spark, rows)).collect()) == sorted(i for i, c in expected.items() if i == c)


def test_near_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK_DOCS", 7)
    rows = invented(seed=8)
    assert dict(got(near.near_digest(table(spark, rows)), "doc_id", "class_id")) == brute.near_classes(rows)


def test_near_unnamed_rows_stay(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = table(spark, [(None, text), (7, text), (7, text), (3, text), (8, None), (9, None)])
    assert sorted(str(r["doc_id"]) for r in near.keep_one(rows).collect()) == ["3", "8", "9", "None"]


def test_myers_is_the_edit_distance():
    rng = random.Random(2)
    for _ in range(400):
        p, t = ("".join(rng.choice("ab c") for _ in range(rng.randint(a, b))) for a, b in ((1, 80), (0, 40)))
        assert decontam.myers(p, t) == brute.edit_search(p, t)


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(3)
    items = ["".join(rng.choice("abcdefgh ij") for _ in range(n)) for n in (150, 90, 30, 14, 5)]

    def edited(item, k):
        x = list(item)
        for _ in range(k):
            x[rng.randrange(len(x))] = rng.choice("xyz")
        return "".join(x)

    texts = [f"{'lorem ipsum ' * rng.randrange(4)}{edited(rng.choice(items), rng.choice((0, 1, 3, 6, 12, 20)))} dolor\n sit" for _ in range(80)] + [None, "", "A" * 3000, items[0].upper()]
    bench = spark.createDataFrame([*enumerate(items), (90, None), (91, " "), (0, items[0])], "item_id bigint, text string")
    rows = list(enumerate(texts))
    out = {r["doc_id"]: [tuple(h) for h in r["hits"]] for r in table(spark, rows).select("doc_id", decontam.benchmark_hits(table(spark, rows), bench).alias("hits")).collect()}
    for i, t in rows:
        expected = [(n, d) for n, item in enumerate(items) if t and (d := brute.edit_search(x := decontam.normal(item), decontam.normal(t))) <= int(len(x) * 0.08)]
        assert out[i] == expected
    sharded = table(spark, rows).select("doc_id", decontam.benchmark_hits(table(spark, rows), bench, shard_chars=60).alias("hits")).collect()
    assert {r["doc_id"]: sorted(tuple(h) for h in r["hits"]) for r in sharded} == out
    assert {r["doc_id"] for r in decontam.clean_documents(table(spark, rows), bench).collect()} == {i for i, h in out.items() if not h}


def test_mixture_meets_targets(spark):
    rng = random.Random(5)
    rows = [(i, "w " * rng.choice((0, 1, 5, 30, 200)), "en", rng.choice(("a", "a", "a", "b", "c", None))) for i in range(600)] + [(700, None, "en", "d"), (701, "w w", "en", "e")]
    out = mixing.mix_digest(table(spark, rows)).collect()
    assert len(out) == len(rows) and sorted(map(tuple, out), key=str) == sorted(map(tuple, mixing.mix_digest(table(spark, rows)).collect()), key=str)
    total = sum(r["size"] for r in out)
    targets = {r["source"]: (r["target"], r["source_size"]) for r in out}
    assert abs(sum(t for t, _ in targets.values()) - total) < 1e-6
    for name, (target, size) in targets.items():
        assert target <= 3 * size + 1e-9
        assert abs(sum(r["taken"] for r in out if r["source"] == name) - target) <= 200
    assert all(r["taken"] <= 3 * r["size"] for r in out) and targets["e"] == (6.0, 2) and targets["d"] == (0.0, 0)
    free = {n: targets[n][0] / w for n, w in (("a", 1), ("b", 2), ("c", 3), (None, 3)) if targets[n][0] < 3 * targets[n][1]}
    assert len({round(x, 6) for x in free.values()}) <= 1
    copies = {}
    for r in mixing.mix(table(spark, rows)).collect():
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    assert copies == {r["doc_id"]: r["copies"] for r in out if r["copies"]}


def test_language_of_held_out_documents(spark, given):
    out = langid.language_digest(given[1]).join(given[1].select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r["held_out"]]
    assert len(held) > 40 and sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in out) and sum(r["rejected"] for r in out) <= 1


def test_language_edges(spark, given):
    known = [(r["doc_id"], r["text"], r["lang"], "s") for r in given[1].collect()]
    odd = table(spark, [*known, (1001, None, "en", "s"), (1002, "", None, "s"), (1003, "123 !? \n", None, "s"), (1004, "漢字仮名交文章漢字仮名交文章" * 9, None, "s")])
    out = {r["doc_id"]: r for r in langid.language_digest(odd).collect()}
    assert [out[i]["lang_pred"] for i in (1001, 1002, 1003)] == ["und"] * 3 and all(out[i]["score"] == 0 and out[i]["rejected"] for i in (1001, 1002, 1003))
    assert out[1004]["rejected"] and out[1004]["lang_pred"] != "und"
    kept = langid.keep_known(odd)
    assert kept.columns == odd.columns and kept.count() >= len(known) - 1
    untaught = langid.language_digest(table(spark, [(1, "some text", None, "s")])).collect()
    assert untaught[0]["lang_pred"] == "und" and untaught[0]["rejected"]


def test_unlearned_languages_are_rejected_at_every_length(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = [(r["doc_id"], r["text"], r["lang"], "s") for r in docs.collect()]
    rng = random.Random(6)
    foreign = [
        "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura, ché la diritta via era smarrita. Ahi quanto a dir qual era è cosa dura",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować",
        " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(26))]
    planted = [(900_000 + 10 * i + k, " ".join([text] * k), None, "s") for i, text in enumerate(foreign) for k in (1, 3, 7, 12)]
    short = [(910_000 + i, "".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randint(20, 60))), None, "s") for i in range(20)]
    clean = [t for _, t, _, _ in known if len(t) > 2000 and len(set(t.split())) > 150][:40]
    keyed = [(920_000 + i, " ".join(t.split()[:n]) + " token = \"" + "".join(rng.choice("0123456789abcdef") for _ in range(40)) + "\" 4011-2233-0099 a.b7@mail4.example.com", None, "s")
             for i, (t, n) in enumerate((t, n) for t in clean for n in (6, 15, 60))]
    out = {r["doc_id"]: r for r in langid.language_digest(table(spark, [*known, *planted, *short, *keyed])).collect()}
    assert len(missed := [i for i, *_ in planted if not out[i]["rejected"]]) <= 3, missed
    assert sum(out[i]["rejected"] for i, *_ in short) >= 15
    assert sum(out[i]["rejected"] for i, *_ in keyed) <= 2
    assert sum(out[i]["rejected"] for i, *_ in known) <= 0.005 * len(known)


def test_secrets_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = F.col("candidate").rlike("^AKIA[0-9A-Z]{16}$") | (F.col("before").rlike("(token|password) ?= ?\"?$") & F.col("candidate").rlike("^[0-9a-f]{16,}$"))
    out = secrets.scan(docs, known, ~langid.held_out(F.col("doc_id"))).withColumn("known", known).where(langid.held_out(F.col("doc_id"))).collect()
    assert len(out) > 40 and sum(r["known"] for r in out) >= 3 and sum(r["known"] != r["secret"] for r in out) <= 1


def verdicts(spark, tmp_path, wanted, plain):
    """What op1 says of the values ``wanted`` and ``plain``, each planted in a text of its own between the documents of sf0.01."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    texts = [f"on the thing and erin {before}{value}{after} the of er" for before, value, after in (*wanted, *plain)]
    docs.unionByName(spark.createDataFrame([(800_000 + i, t, "en", f"src{i % 8}") for i, t in enumerate(texts)], docs.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    out = {(r["doc_id"], r["candidate_sha256"]): r["secret"] for r in queries.op1_secret_scan(spark, str(tmp_path)).where("doc_id >= 800000").collect()}
    found = [out.get((800_000 + i, brute.sha(v.encode()))) for i, (_, v, _) in enumerate((*wanted, *plain))]
    return found[:len(wanted)], found[len(wanted):]


def test_upper_case_and_other_secrets_are_not_taught_as_false(spark, tmp_path):
    rng = random.Random(9)
    value = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    wide = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    wanted = [x for _ in range(20) for x in (
        ('TOKEN = "', value("0123456789ABCDEF", 40), '"'), ("api_key: ", value(wide, 32), ""), ('password="', value(wide + "+/", 28), '"'), ("access_key=", "ghp_" + value(wide, 36), ""))]
    found, _ = verdicts(spark, tmp_path, wanted, [])
    assert None not in found
    assert all(sum(found[k::4]) >= 18 for k in range(4)), [sum(found[k::4]) for k in range(4)]


def test_values_after_credential_words_are_findings(spark):
    dotted = "ab.cd!ef@gh.ij#kl$mn%op=qr"
    rows = [(1, 'password = "Tr0ub4dor&3"'), (2, "pwd: hunter2!x, then"), (3, f"AUTH_TOKEN={dotted}."), (4, "{'api-key': 'q w.e-r t'}"), (5, "author: somebody, secret=abc"), (6, 'token="closed1 not here'),
            (7, "the password Tr0ub4dor&3"), (8, "secret = " + "aB3." * 9 + " and 0123456789abcdef0"), (9, 'DB_PASSWORD_2 := "' + "a" * 15 + '"')]
    assert got(secrets.findings(table(spark, rows)), "doc_id", "candidate") == [
        (1, "Tr0ub4dor&3"), (2, "hunter2!x"), (3, dotted), (4, "q w.e-r t"),
        (6, "closed1"), (8, "0123456789abcdef0"), (8, "aB3." * 8 + "aB3"), (9, "a" * 15)]


def test_short_and_dotted_secrets_are_kept(spark, tmp_path):
    rng = random.Random(10)
    value = lambda n: "".join(rng.choice("ABCDEFGHJKMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz23456789") for _ in range(n))
    wanted = [x for _ in range(20) for x in (('password = "', value(8) + "&3", '"'), ("secret=", value(9) + "!x", ""), ("token: ", ".".join((value(10), value(12), value(9))), ""))]
    found, _ = verdicts(spark, tmp_path, wanted, [])
    assert None not in found
    assert all(sum(found[k::3]) >= 16 for k in range(3)), [sum(found[k::3]) for k in range(3)]


def test_secret_edges(spark):
    rows = [(1, None), (2, ""), (3, "password=0123456789abcdef0 and 0123456789abcdef0-tail"), (3, "password=0123456789abcdef0 and 0123456789abcdef0-tail"), (4, "plain words only"), (None, "x" * 5000)]
    found = secrets.findings(table(spark, rows)).collect()
    assert sorted((r["doc_id"] or 0, r["nth"], r["candidate"][:20], r["before"]) for r in found) == [
        (0, 0, "x" * 20, ""), *[(3, 0, "0123456789abcdef0", "password=")] * 2, *[(3, 1, "0123456789abcdef0-ta", " and ")] * 2]
    assert {r["secret"] for r in secrets.scan(table(spark, rows), F.lit(False), F.lit(True)).collect()} == {False}
    assert {r["secret"] for r in secrets.scan(table(spark, rows), F.lit(None).cast("boolean"), F.lit(True)).collect()} == {True}


def test_empty_tables(spark):
    none = table(spark, [])
    bench = spark.createDataFrame([], "item_id bigint, text string")
    for df in (lines.line_digest(none), lines.dedup_lines(none), passages.passage_digest(none), suffixes.suffix_digest(none), near.near_digest(none), near.keep_one(none),
               decontam.contamination_digest(none, bench), mixing.mix_digest(none), mixing.mix(none), langid.language_digest(none), langid.keep_known(none),
               secrets.scan(none, F.lit(True), F.lit(True))):
        assert df.collect() == []
    some = table(spark, [(1, "text")])
    assert decontam.clean_documents(some, bench).count() == 1


def byte_brute(rows, span=400):
    """Bytes under a string of ``span`` bytes that starts twice, by a table of all strings."""
    seen = {}
    texts = [(t or "").encode() for _, t in rows]
    for raw in texts:
        for i in range(len(raw) - span + 1):
            h = hash(raw[i:i + span])
            seen[h] = seen.get(h, 0) + 1
    out = []
    for (i, _), raw in zip(rows, texts, strict=True):
        gone = bytearray(len(raw))
        for k in range(len(raw) - span + 1):
            if seen[hash(raw[k:k + span])] > 1:
                gone[k:k + span] = b"\x01" * span
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((i, len(raw), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), brute.sha(kept)))
    return out


def test_suffixes_of_the_given_table_match_brute_force(spark, given):
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    want = sorted(byte_brute(given[0]))
    assert sum(r[2] > 0 for r in want) > 20
    assert got(suffixes.suffix_digest(given[1]), *columns) == want


def test_planted_passages_of_the_span_are_all_found(spark):
    rng = random.Random(6)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(430))
    own = ["".join(rng.choice("ijklmnop ") for _ in range(700)) for _ in range(40)]
    rows = [(i, t[:200 + i] + (passage if i % 2 else passage[:380]) + t[200 + i:]) for i, t in enumerate(own)]
    removed = {r["doc_id"]: r["n_removed"] for r in suffixes.suffix_digest(table(spark, rows)).collect()}
    assert all(removed[i] >= 430 if i % 2 else removed[i] == 0 for i in range(40))


def test_suffix_cells_do_not_depend_on_the_order_of_rows():
    import pyarrow as pa

    rows = invented(n=20) + [(None, "x" * 900), (None, "y" * 900), (3, "another text " * 60)]
    tables = []
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        tables.append(suffixes.Cell(pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]}), 400))
    assert (tables[0].at == tables[1].at).all() and (tables[0].raw == tables[1].raw).all() and tables[0].ids == tables[1].ids


def test_index_entries_and_contexts_are_spread_over_all_ranges():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(9)
    docs = pa.table({"doc_id": list(range(60)), "text": ["".join(rng.choices("abcdefghijklmnop ", k=6000)) for _ in range(60)], "cell": [0] * 60})
    asks = [r for r in suffixes._ask_suffixes(docs, 400, 8).to_pylist() if r["step"] == 1]
    held = [len(r["hashes"]) // 8 for r in asks]
    assert [r["range"] for r in asks] == list(range(8)) and sum(held) > 1500 and max(held) < 1.4 * sum(held) / 8
    cell = suffixes.Cell(docs, 400)
    cell.contexts(np.ones(len(cell.prints), dtype=bool))
    assert np.diff(suffixes.c.cut(cell.f, 8)).max() < 1.4 * len(cell.f) / 8


def test_lines_of_a_very_long_text(spark):
    shared = "a shared line that is longer than forty characters"
    rows = [(i, "\n".join(shared if n % 3 == i % 3 else f"line {n}" for n in range(40_000 if i == 0 else 300))) for i in range(9)]
    expected = sorted((i, n, g, brute.sha(k.encode())) for (i, _), (n, g, k) in zip(rows, brute.drop_lines(rows), strict=True))
    assert got(lines.line_digest(table(spark, rows)), "doc_id", "n_lines", "n_dropped", "kept_sha256") == expected


def test_items_beyond_one_shard_meet_texts_in_groups(spark, monkeypatch):
    rng = random.Random(11)
    items = [(i, " ".join(f"w{rng.randrange(500)}" for _ in range(14))) for i in range(12)] + [(40, None), (41, " "), (7, "a second text of item seven that is long enough")]
    rows = [(i, f"{i} " + (items[i % 12][1] if i % 3 == 0 else "") + " end " + (items[(i + 5) % 12][1].replace("w1", "x1", 1) if i % 5 == 0 else "")) for i in range(60)]
    rows += [(5, rows[0][1]), (5, rows[0][1]), (None, None), (70, ""), (71, items[14][1].upper())]
    docs, bench = table(spark, rows), spark.createDataFrame(items, "item_id bigint, text string")
    columns = ("doc_id", "contaminated", "n_items", "item_ids", "distances")
    one, many = ([tuple(map(str, r)) for r in decontam.contamination_digest(docs, bench, shard_chars=n).select(*columns).collect()] for n in (4_000_000, 150))
    assert sorted(one) == sorted(many) and sum(r[1] == "True" for r in one) > 20
    kept = decontam.clean_documents(docs, bench, shard_chars=150)
    assert kept.columns == docs.columns and kept.count() == sum(r[1] == "False" for r in one)


def test_vectors_of_extreme_size_link_by_cosine(spark):
    from webestate.llm import vectors

    base = [[1.0, 2.0, 3.0, -1.0], [1.1, 2.0, 3.0, -1.0], [-3.0, 1.0, 0.0, 2.0]]
    rows = [(n * 10 + k, [x * s for x in v]) for n, s in enumerate((1.0, 1e200, 1e-200)) for k, v in enumerate(base)]
    got_ = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.vector_links(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    assert got_ == {i: (5, 0) if i % 10 < 2 else (2, 2) for i, _ in rows}
