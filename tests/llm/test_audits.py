"""Source divergence, token files and the filter audit against brute force."""

import itertools
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from recurra.llm import divergence, filter_audit, token_files

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string"
#: Columns that the operators use for themselves inside.
CLASHING = ["1 AS term", "2 AS n", "3 AS part", "4 AS words", "5 AS A", "6 AS digest", "7 AS first", "8 AS file", "9 AS value", "10 AS total"]


def sources(seed=0, n=150):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang, source = rng.choice(["en", "de", None, ""]), rng.choice(["web", "web", "web", "news", "é", None])
        words = [rng.choice(["The", "the", "tHE", "straße", "ÄPFEL", "x1y", "a_b", "c-d", f"w{rng.randrange(9)}", f"{source}ly"]) for _ in range(rng.randrange(30))]
        rows.append((i, " ".join(words), lang, source))
    return rows + [(1000, None, "en", "silent"), (1001, "12 34 __", "fr", "digits"), (1002, None, "fr", "none"), (None, "the the the", "en", "web"), (5, rows[5][1], "de", "web"), (1003, "lone term", "it", "one")]


def divergence_rows(rows, min_docs, top):
    clean = [(i, (t or ""), lang or "", source or "") for i, t, lang, source in rows]
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    docs, counts, groups = Counter(), defaultdict(Counter), set()
    for _, text, lang, source in clean:
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text.translate(lower))
        groups.add((lang, source))
        counts[lang, source].update(terms)
        docs.update((lang, t) for t in set(terms))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (k, t), n in docs.items() if k == lang and n >= min_docs)
        own = {s: {t: counts[lang, s][t] for t in kept} for k, s in groups if k == lang}
        whole = {t: sum(c[t] for c in own.values()) for t in kept}
        part = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        p, q = {s: part(c) for s, c in own.items()}, part(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in own:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in own if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if own[s][t] and p[s][t] > q[t]]
            for name, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out |= {(lang, s, name, item, v, i + 1) for i, (v, item) in enumerate(ranked)}
    return out


@pytest.mark.parametrize("min_docs,top", [(10, 10), (1, 3), (1000, 1)])
def test_source_divergence(spark, min_docs, top):
    rows = sources()
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", *CLASHING).repartition(3)
    found = divergence.source_divergence(docs, min_docs, top).collect()
    assert len(found) == len({tuple(r) for r in found})
    assert {(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in found} == divergence_rows(rows, min_docs, top)


def test_cells_cover_the_vocabulary(spark):
    kept = spark.createDataFrame([("en", "a", "x", 2, 3, True), ("en", "b", "x", 1, 3, False), ("en", "a", "y", 2, 2, True), ("en", "b", "z", 1, 1, True)], "lang string, source string, term string, n long, whole long, head boolean")
    pairs = spark.createDataFrame([("en", "a", "b", 3), ("en", "a", "c", 3), ("en", "b", "c", 3)], "lang string, one string, two string, size long")
    found = {(r.one, r.two, r.a, r.b): r.terms for r in divergence.cells(kept, pairs).collect()}
    assert found == {("a", "b", 2, 1): 1, ("a", "b", 2, 0): 1, ("a", "b", 0, 1): 1, ("a", "c", 2, 0): 2, ("a", "c", 0, 0): 1, ("b", "c", 1, 0): 2, ("b", "c", 0, 0): 1}


def test_no_rows(spark, tmp_path):
    none = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert divergence.source_divergence(none).collect() == []
    assert token_files.read_documents(token_files.write_token_files(none, f"file://{tmp_path}/none")).collect() == []
    assert filter_audit.filter_audit(filter_audit.flagged(none, labels), [*"ABCDE"]).collect() == []


def test_bad_parameters(spark, tmp_path):
    none = spark.createDataFrame([], DOCS)
    for make in (lambda: divergence.source_divergence(none, 0), lambda: token_files.write_token_files(none, f"file://{tmp_path}", length=0), lambda: filter_audit.filter_audit(none, ["AA"]), lambda: filter_audit.filter_audit(none, ["A", "A"])):
        with pytest.raises(ValueError):
            make()


TEXTS = [
    (7, "Hello  wörld's\n<|endoftext|> it'S ＡＢＣ é 12345"), (3, None), (5, ""), (5, "twice"), (5, "twice"), (None, "no id"), (None, None), (2, " \t\n\x0b\x0c\r"), (9, "ΣΊΣΥΦΟΣ ΑΣ İstanbul ſ  x\u0085y a​b"),
    (1, "word " * 5000), (8, "x" * 100_000), (4, "\U0001f600\U0001f468‍\U0001f469 'll 'LL d'd <|startoftext|>a<|endoftext|>"), (6, "́ ́a ẛ̣ ﬁ"),
]


def in_order(rows):
    """Rows by id, nulls first; equal ids in any order."""
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


@pytest.mark.parametrize("name,end,length,rows", [("word_bpe_49k.json", 2, 64, 3), ("byte_bpe_50k.json", 0, 7, 2), ("word_bpe_49k.json", 2, 1, 1)])
def test_token_files(spark, tmp_path, name, end, length, rows):
    import public_tokenizers

    library = Tokenizer.from_file(public_tokenizers.path(name))
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").selectExpr("*", *CLASHING).repartition(3)
    files = token_files.write_token_files(docs, f"file://{tmp_path}/out", public_tokenizers.path(name), end, length, rows, file_bytes=40_000)
    assert files.count() > 1
    found = sorted(token_files.read_documents(files).collect(), key=lambda r: r.start)
    ids = lambda t: np.array([*library.encode(t or "", add_special_tokens=False).ids, end], "<u4")
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == Counter((i, len(ids(t)), zlib.crc32(ids(t).tobytes())) for i, t in TEXTS)
    assert [r.doc_id for r in found] == [r[0] for r in in_order(TEXTS)]
    assert [r.start for r in found] == [0, *np.cumsum([r.n_tokens for r in found])[:-1]]
    # The whole stream from the sequences of all files, by their masks.
    stream = []
    for f in files.orderBy("file").collect():
        file = token_files.TokenFile(f.ids_uri)
        assert len(file) == f.sequences and file.length == length
        for i in random.Random(0).sample(range(len(file)), len(file)):
            assert file.sequence(i)[0].shape == (length,)
        each = [file.sequence(i) for i in range(len(file))]
        each = [(x, mask.to_numpy(zero_copy_only=False)) for x, mask in each]
        assert all(mask.all() for _, mask in each[:-1])
        stream += [x[mask] for x, mask in each]
    assert zlib.crc32(np.concatenate(stream).astype("<u4").tobytes()) in {zlib.crc32(b"".join(ids(t).tobytes() for _, t in order)) for order in repeats_any_way(in_order(TEXTS))}


def repeats_any_way(rows):
    """Rows in every order of those that share an id."""
    for parts in itertools.product(*(itertools.permutations(list(g)) for _, g in itertools.groupby(rows, key=lambda r: r[0]))):
        yield [r for p in parts for r in p]


def test_sequences_are_views_of_the_file(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"some words of text {i} " * 40) for i in range(60)], "doc_id long, text string")
    uri = token_files.write_token_files(docs, f"file://{tmp_path}/out", length=128, rows=4, file_bytes=1 << 30).first().ids_uri
    file = token_files.TokenFile(uri)
    before = pa.total_allocated_bytes()
    held = [file.sequence(i) for i in range(len(file))]
    assert pa.total_allocated_bytes() == before
    assert all(not x.flags.owndata and not x.flags.writeable and x.dtype == np.uint16 and len(m) == 128 for x, m in held)
    mapped = os.path.getsize(uri.removeprefix("file://"))
    first, last = held[0][0].ctypes.data, held[-1][1].buffers()[1].address
    assert 0 < last - first < mapped


def test_words_give_the_ids_of_texts():
    """Encoding word by word, as the files are written, against the library on whole texts."""
    rng = random.Random(4)
    some = "aAbz 's'll'd  \t\n09.,!-_<|>éÉßΣσς́̀  ​\U0001f600中文İıſ×÷µÿÞ"
    plain = "stmdrvelSTMDRVELaé'' ,1 "
    texts = ["".join(rng.choice(chars) for _ in range(rng.randrange(60))) for chars in (some, plain) for _ in range(3000)]
    texts += ["we'll they'VE 'tis ''s rock'n'roll x's't I'm,'d 'r 'v 'l '", "<|endoftext|>'s <|startoftext|", "\x01a\x7f b\x00", *(chr(c) * 2 + "e" for c in range(0x21, 0x250))]
    encoder = token_files.WordEncoder(token_files.default_path(), keep=500)
    assert encoder.parted
    ids, offsets = encoder.block(pa.array(texts), 2)
    library = Tokenizer.from_file(token_files.default_path())
    for i, t in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == [*library.encode(t, add_special_tokens=False).ids, 2]


def test_query_of_token_files(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    found = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.op12_token_files(spark, DATA).collect()}
    library, at = Tokenizer.from_file(token_files.default_path()), 0
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    assert len(found) == len(rows)
    for i, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert found[i] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def filter_rows(seed=1, n=120):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["", "AB ", "x # y ", "Z"]) + " ".join(rng.choice(["a", "Bc", "d", f"w{rng.randrange(90)}"]) for _ in range(rng.choice([3, 49, 60, 200]))), "en", rng.choice(["web", "news", None])) for i in range(n)]
    copies = [(n + i, rows[i][1], "en", rng.choice(["web", "other"])) for i in range(0, n, 3)]
    return rows + copies + [(900, None, "en", "web"), (901, "", "en", "web"), (902, None, "en", None), (None, rows[0][1], "en", "web"), (None, rows[0][1], "en", "web"), (5, rows[5][1], "en", "news"), (903, "A" * 70 + "   é", "en", "")]


def audit_rows(rows, labels):
    quality, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    docs = []
    for i, t, _, source in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0d]+", t)
        fails = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and i > least[t],
        }
        docs.append((source or "", {k for k, v in fails.items() if v}, i in quality, i in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        own, shapley, made = [d for d in docs if d[0] == part], Counter(), []
        for order in itertools.permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                failing = sum(f in d[1] for d in own)
                shapley[f] += len(gone)
                made.append(("".join(order), k + 1, f, len(left), len(gone), failing - len(gone), sum(d[1] == {f} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone)))
        out |= {(part, o, k): (*x, shapley[f]) for o, k, f, *x in made}
    return out


def test_filter_audit(spark):
    rows = filter_rows()
    rng = random.Random(2)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 140, 2)] + [(4, 0, 0), (4, 1, 1), (None, 1, 1), (5000, 1, 1)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", *(c for c in CLASHING if "A " not in c)).repartition(3)
    flags = filter_audit.flagged(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert flags.count() == len(rows)
    found = filter_audit.filter_audit(flags, [*"ABCDE"]).collect()
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in found}
    assert got == audit_rows(rows, labels) and len(found) == len(got)


def test_each_state_is_entered_once(spark, monkeypatch):
    """Depth first, 31 states of five filters, and at most one held for each filter applied."""
    entered, held, most = [], [0], [0]
    rows = spark.createDataFrame([("p", *[i >> k & 1 == 1 for k in range(5)], False, False) for i in range(32)], "part string, A boolean, B boolean, C boolean, D boolean, E boolean, good boolean, toxic boolean")
    count, kind = filter_audit.edge_counts, type(rows)
    keep, let_go = kind.persist, kind.unpersist

    def persist(self, *a):
        held[0] += 1
        most[0] = max(most[0], held[0])
        return keep(self, *a)

    def unpersist(self, *a):
        held[0] -= 1
        return let_go(self, *a)

    monkeypatch.setattr(filter_audit, "edge_counts", lambda s, state, ahead: entered.append(state) or count(s, state, ahead))
    monkeypatch.setattr(kind, "persist", persist)
    monkeypatch.setattr(kind, "unpersist", unpersist)
    edges = filter_audit.walked(rows, [*"ABCDE"])
    assert len(entered) == len({*entered}) == 31 and held == [0] and most == [4]
    assert edges.count() == 80 and {r.removed for r in edges.where("length(state) = 2").collect()} == {4}


