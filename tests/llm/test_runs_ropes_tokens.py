"""Operators 11 to 13 against brute force, with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest
import sentencepiece
from pyspark.sql import functions as F

from stepquarry.llm import queries, rope_fim, tandem_runs, token_counts

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, n long, runs string, h string, drawn int, a int"
MODEL = queries.tokenizer_path("piece_bpe_32k.model")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(7)

    def text():
        out = []
        while len(out) < rnd.randint(0, 70):
            block = [rnd.choice(["a", "b", "çé", "😀x", "The"]) for _ in range(rnd.randint(1, 6))]
            out += block * rnd.choice([1, 1, 1, 3, 4, 6])
        return "".join(w + rnd.choice([" ", " ", "\n", "\t  "]) for w in out)

    odd = [None, "", " ", " \n\t", "x", "x" * 5000, "a " * 3000, "one\x1ctwo\x85three　four", "has <P> inside", "<S", "ends with <", "漢字かな" * 400, "the " + " " * 70 + "end", "\x00 \x00 nul", "▁ ▁▁ <s> </s> <0x41>"]
    out = [(i, text()) for i in range(150)] + [(1000 + i, t) for i, t in enumerate(odd)] + [(None, "no id no id no id no id"), (5, "same id"), (-3, "a b c")]
    out += [out[0], out[0]]
    return [(*r, 7, "r", "h", 1, 2) for r in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_runs(w, least_length=6, least_power=4):
    found = set()
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            length = j - i + p
            if j > i and length >= max(least_length, least_power * p) and not any(all(w[x] == w[x + q] for x in range(i, i + length - q)) for q in range(1, p)):
                found.add((i, length, p))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def planted_words(doc_id, text):
    w = (text or "").encode().split()
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is None or h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def test_runs_query_equals_brute_force(docs, rows, none):
    want = []
    for doc_id, text, *_ in rows:
        w = planted_words(doc_id, text)
        runs = [(0, len(w), 1)] if len(w) > 500 and len(set(w)) == 1 else brute_runs(w)
        gone = {i for s, length, p in runs for i in range(s + p, s + length)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        want.append((doc_id, len(runs), *four, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(b" ".join(x for i, x in enumerate(w) if i not in gone).decode())))
    got = tandem_runs.planted_runs(docs)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert any(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows) and tandem_runs.planted_runs(none).count() == 0


@pytest.mark.parametrize("limits", [(6, 4), (2, 2), (1, 3)])
def test_runs_of_lots_equal_brute_force(monkeypatch, limits):
    monkeypatch.setattr(tandem_runs, "LEAVES", 7)
    rnd = random.Random(sum(limits))
    for _ in range(150):
        texts = []
        for _ in range(rnd.randint(1, 4)):
            w = []
            while len(w) < rnd.randint(0, 50):
                w += [rnd.choice([b"a", b"b", b"c"]) for _ in range(rnd.randint(1, 5))] * rnd.choice([1, 1, 2, 4, 7])
            texts.append(w[: len(w) - rnd.randint(0, 2)])
        assert tandem_runs.maximal_runs(texts, *limits) == [brute_runs(w, *limits) for w in texts]


def test_runs_of_long_texts_are_found_in_time():
    one = [b"a"] * 60_000
    cycle = [b"%d" % (i % 4001) for i in range(40_000)]
    plain = [b"%d" % i for i in range(40_000)]
    assert tandem_runs.maximal_runs([one, cycle, plain]) == [[(0, 60_000, 1)], [(0, 40_000, 4001)], []]
    assert tandem_runs.collapse(cycle, [(0, 40_000, 4001)]) == cycle[:4001]


def test_find_runs_keeps_spans_and_texts(spark):
    got = tandem_runs.find_runs(spark.createDataFrame([(1, "x y y y y y y z")], "doc_id long, text string")).first()
    assert got.n_words == 8 and [tuple(r) for r in got.runs] == [(1, 6, 1)] and got.collapsed == "x y z"
    with pytest.raises(ValueError):
        tandem_runs.find_runs(spark.createDataFrame([(1, "x")], "doc_id long, text string"), least_power=1)


def cut_and_arranged(doc_id, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    hashed = sha(f"42:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(hashed[k : k + 8], 16) for k in range(0, 32, 8))
    if not text or h3 % 100 >= 50 or any(m in text for m in ("<P>", "<S>", "<M>")):
        return len(units), "plain", None, None, text
    one, two = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:one]), "".join(units[one:two]), "".join(units[two:])
    return (len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else (len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("leaf", [1, 30, 1024])
def test_ropes_arrange_and_restore(monkeypatch, rows, leaf):
    monkeypatch.setattr(rope_fim, "LEAF", leaf)
    rnd, forms = random.Random(leaf), set()
    for _, text, *_ in rows:
        text = text or ""
        tree = rope_fim.rope(text)
        units = rope_fim.UNIT.findall(text)
        assert (tree.units, tree.chars, "".join(tree.leaves())) == (len(units), len(text), text)
        one, two = sorted(rnd.randint(0, len(units)) for _ in range(2))
        head, suffix = rope_fim.split(tree, two)
        prefix, middle = rope_fim.split(head, one)
        assert [("".join(x.leaves()), x.chars) for x in (prefix, middle, suffix)] == [(t := "".join(u), len(t)) for u in (units[:one], units[one:two], units[two:])]
        if not any(m in text for m in rope_fim.SENTINELS):
            for form in ("psm", "spm"):
                whole = rope_fim.arrange((prefix, middle, suffix), form, rope_fim.SENTINELS)
                assert rope_fim.restore("".join(whole.leaves()), form, rope_fim.SENTINELS) == text
                forms.add(form)
    assert forms == {"psm", "spm"}


def test_ropes_stay_balanced():
    rnd, tree = random.Random(3), rope_fim.EMPTY
    for k in range(3000):
        tree = rope_fim.join(tree, rope_fim.leaf(f"w{k} ")) if rnd.random() < 0.5 else rope_fim.join(rope_fim.leaf(f"w{k} "), tree)
    assert tree.height < 20
    for _ in range(200):
        a, b = rope_fim.split(tree, rnd.randint(0, tree.chars), "chars")
        tree = rope_fim.join(b, a)
    assert tree.height < 24 and len("".join(tree.leaves())) == tree.chars


def test_fill_in_middle_query(docs, rows, none, spark):
    got = rope_fim.restored(rope_fim.fill_in_middle(docs)).collect()
    want = [(r[0], *cut_and_arranged(r[0], r[1]), r[1] or "") for r in rows]
    assert sorted(str(tuple(r)) for r in got) == sorted(map(str, want)) and {w[2] for w in want} == {"plain", "psm", "spm"}
    digest = rope_fim.digest(docs)
    assert sorted(str(tuple(r)) for r in digest.collect()) == sorted(str((*w[:5], sha(w[5]), sha(w[6]))) for w in want)
    assert rope_fim.digest(none).count() == 0
    for wrong in (("<a", "a>", "m"), ("s", "s", "m"), ("a b", "c", "d"), ("", "b", "c"), ("xyx", "b", "c"), ("b", "abc", "d")):
        with pytest.raises(ValueError):
            rope_fim.fill_in_middle(docs, sentinels=wrong)


def test_fill_in_middle_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    want = con.sql(queries.ORACLE["op12_fill_in_middle"])
    got = queries.op12_fill_in_middle(spark, DATA)
    assert got.columns == want.columns and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_every_prefix_has_the_librarys_count(library):
    counter = token_counts.counter_for(token_counts.definition(MODEL))
    rnd = random.Random(11)
    bits = ["a", "b", "the", " ", "  ", "\n", "\t", "é", "①", "漢", "字", "▁", "\x00", "ing", "er", "http://", "0", "1", "<s>", "😀", " " * 9, "aaaa", "<0x41>", "<unk>"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 60))) for _ in range(200)] + [" " * k for k in range(0, 70, 3)] + [" " * k + "the" for k in range(40)]
    for t in texts:
        assert counter.table(t).tolist() == [len(x) for x in library.encode([t[:k] for k in range(len(t) + 1)])]


def test_token_counts_query(docs, rows, none, library, monkeypatch):
    monkeypatch.setattr(token_counts, "BATCH", 500)
    want = [(r[0], len((r[1] or "").encode()), n := len(library.encode(r[1] or "")), n > 40) for r in rows]
    got = token_counts.counted(docs, MODEL, limit=40)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit", "chars_in_limit"]
    assert sorted(str(tuple(r)[:4]) for r in got.collect()) == sorted(map(str, want)) and {w[3] for w in want} == {True, False}
    assert token_counts.counted(none, MODEL).count() == 0


def test_budgets_are_answered_from_the_table(docs, rows, library):
    tables = token_counts.prefix_counts(docs, MODEL)
    got = tables.select("doc_id", token_counts.longest_prefix(9).alias("k"), token_counts.count_at(12).alias("c"), token_counts.count_at(F.lit(-1)).alias("z")).collect()
    want = []
    for doc_id, text, *_ in rows:
        text = text or ""
        counts = [len(x) for x in library.encode([text[:k] for k in range(min(len(text), 300) + 1)])]
        want.append((doc_id, max(k for k, c in enumerate(counts) if c <= 9), counts[min(12, len(text))], 0))
    assert sorted(str(tuple(r)) for r in got) == sorted(map(str, want))


def test_the_query_equals_the_library(spark, library):
    texts = {r.doc_id: r.text or "" for r in queries.table(spark, DATA, "documents").collect()}
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op13_token_counts(spark, DATA).collect()}
    assert got == {i: (len(t.encode()), n := len(library.encode(t)), n > 4096) for i, t in texts.items()}


def test_models_that_are_not_covered_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    model.ParseFromString(open(MODEL, "rb").read())
    model.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "other.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        token_counts.definition(str(tmp_path / "other.model"))


def test_only_pieces_are_tried():
    """The automaton's pieces at each character are those of the vocabulary that end there, the longest first; also when transitions were kept."""
    rnd = random.Random(8)
    pieces = {"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 6))): -float(k) for k in range(60)}
    counter = token_counts.PrefixCounter(pieces)
    for _ in range(2):
        for text in ("".join(rnd.choice("abcx") for _ in range(40)) for _ in range(50)):
            state = 0
            for end, c in enumerate(text, 1):
                state = to if (to := counter.next[state].get(c)) is not None else counter.step(state, c)
                own = [counter.names[number] for _, number in counter.ending[state]]
                assert own == [text[a:end] for a in range(end) if text[a:end] in pieces] and [n for n, _ in counter.ending[state]] == [*map(len, own)]
