"""Turn repair, prefix token counts and fill-in-middle against plain Python, and their defined results for odd rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from echoloom.llm import fill_middle, prefix_tokens, queries, turn_repair

TURNS = "conv_id long, turn long, role string, text string"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def sha(text):
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


# ---- 11


def damage(table):
    out = defaultdict(list)
    for r in table:
        conv, turn, role, text = r["conv_id"], r["turn"], r["role"], r["text"]
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        k = zlib.crc32(key.encode()) % 20
        if k == 0:
            continue
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(k, text)
        out[conv] += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return {c: sorted(v, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, v in out.items()}


def faults(conversation):
    seen, out = set(), []
    for _, role, text in conversation:
        inked = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not inked else "duplicate" if (role, text) in seen else "fine" if inked[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def shortest(initials, marks):
    """Every edit sequence, cheapest first, ties by letters: a search over (row, text of initials so far)."""
    legal = re.compile(r"(s?(ua)*u?)?").fullmatch  # prefixes of the grammar that can still be completed
    best = {}
    layer = {(0, ""): (0, "")}
    for i in range(len(initials) + 1):
        for _ in range(2):
            for (k, said), (cost, audit) in list(layer.items()):
                for x in "ua":
                    if legal(said + x):
                        new, at = (cost + 2, audit + "I"), (k, said + x)
                        if at not in layer or new < layer[at]:
                            layer[at] = new
        if i == len(initials):
            return min(v for (k, said), v in layer.items() if re.fullmatch(r"(s?(ua)+)?", said))
        nxt = {}

        def put(said, value):
            # what follows depends on the last initial alone, and on whether there is any
            key = (i + 1, said)
            if key not in nxt or value < nxt[key]:
                nxt[key] = value

        for (k, said), (cost, audit) in layer.items():
            put(said, (cost + 3, audit + "D"))
            if marks[i] in ("blank", "duplicate"):
                continue
            more = cost + (marks[i] == "truncated")
            if initials[i] and legal(said + initials[i]):
                put(said + initials[i], (more, audit + "K"))
            for x in "ua":
                if legal(said + x):
                    put(said + x, (more + 2, audit + "R"))
        layer = {}
        for (k, said), v in nxt.items():
            short = said if len(said) < 4 else said[-2:] if said[-1] == "a" else said[-3:]
            if (k, short) not in layer or v < layer[(k, short)]:
                layer[(k, short)] = v
    return best


def said_again(conversation, audit):
    out, rest, before = [], iter(conversation), ""
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(rest)[1:]
        if letter == "D":
            continue
        if letter != "K":
            role = "assistant" if before == "u" else "user"
        before = role[0]
        out.append(f"{role}:{text}")
    return "\n".join(out)


def expected(table):
    found = damage(table)
    out = {}
    for c in {r["conv_id"] for r in table}:
        v = found.get(c, [])
        marks, initials = faults(v), [role[:1] for _, role, _ in v]
        turns = {t for t, _, _ in v if t is not None}
        cost, audit = shortest(initials, marks)
        out[c] = {
            "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            **{k: marks.count(k) for k in ("blank", "duplicate", "truncated")},
            "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            "cost": cost, "audit": audit, "repaired_sha256": sha(said_again(v, audit)),
        }
    return out


def check(spark_rows, table):
    want = expected(table)
    assert len(spark_rows) == len(want)
    for r in spark_rows:
        assert r == {"conv_id": r["conv_id"], **want[r["conv_id"]]}


def test_turn_repair_equals_search(spark, sf):
    check(rows(queries.op11_turn_repair(spark, sf)), rows(spark.read.parquet(f"{sf}/conversations.parquet")))


def made(rng, conversations, longest, text=lambda rng: rng.choice(["yes.", "no", "why?", " ", "", None, "a b", "ok!\n"])):
    out = []
    for c in conversations:
        for t in range(rng.randint(0, longest)):
            turn = rng.choice([t, t, t, t, t // 2, None])
            out.append((c, turn, rng.choice(["user", "assistant", "assistant", "user", "system", "tool", "", None]), text(rng)))
    return out


def test_turn_repair_of_odd_rows(spark):
    table = made(random.Random(3), [None, *range(1, 150)], 12)
    t = spark.createDataFrame(table, TURNS)
    for c in ("_key", "segment", "copy", "paths", "part", "audit", "cost"):
        t = t.withColumn(c, F.lit("clash"))
    check(rows(turn_repair.contract_digests(t)), rows(t.select("conv_id", "turn", "role", "text")))


def test_turn_repair_cuts_long_conversations(spark, monkeypatch):
    """Segments of 8 rows joined give what whole conversations give."""
    rng = random.Random(4)
    text = lambda rng: rng.choice([f"line {rng.randrange(60)}.", f"cut {rng.randrange(40)}", "", "same."])
    table = [(*r[:1], r[1], *r[2:]) for r in made(rng, [None, 1, 2, 3], 90, text)] + made(rng, range(4, 20), 7, text)
    t = spark.createDataFrame(table, TURNS).repartition(5)
    monkeypatch.setattr(turn_repair, "SEGMENT", 8)
    whole, parts = turn_repair._repaired(turn_repair.damaged(t))
    assert parts is not None and parts.where("segment < 0").count() == 0 and parts.groupBy("_key").count().where("count > 4").count() > 0
    check(rows(turn_repair.contract_digests(t)), rows(t))


def test_turn_repair_of_nothing_and_of_repeats(spark):
    assert rows(turn_repair.contract_digests(spark.createDataFrame([], TURNS))) == []
    t = spark.createDataFrame([(7, 1, "user", "hello there.")] * 700 + [(7, 2, "assistant", "x" * 300_000 + ".")], TURNS)
    got = {r["_key"]: r for r in rows(turn_repair.digests(t))}["=7"]
    assert (got["duplicate"], got["cost"], got["audit"]) == (699, 3 * 699, "K" + "D" * 699 + "K")
    assert got["repaired_sha256"] == sha("user:hello there.\nassistant:" + "x" * 300_000 + ".")


def test_two_inserts_are_enough():
    """Every row of initials up to four turns, against the search without the bound."""
    table = turn_repair.moves()
    steps = defaultdict(list)
    for m in table.itertuples():
        steps[m.source, m.initial, m.fault].append((m.target, m.cost, m.letters))
    for n in range(5):
        for initials in product("sua-", repeat=n):
            for marks in product(("fine", "blank", "truncated"), repeat=n) if n < 4 else [("fine",) * n]:
                ways = {0: (0, "")}
                for i, f in zip(initials, marks, strict=True):
                    new = {}
                    for s, (c, a) in ways.items():
                        for target, cost, letters in steps[s, i, f]:
                            v = (c + cost, a + letters)
                            new[target] = min(new.get(target, v), v)
                    ways = new
                got = turn_repair.best_end([{"target": s, "cost": c, "audit": a} for s, (c, a) in ways.items()])
                assert got == shortest(["" if i == "-" else i for i in initials], marks)


# ---- 12


def library_counts(text):
    return [len(e.ids) for e in prefix_tokens.table().library.encode_batch([text[:k] for k in range(1, len(text) + 1)], add_special_tokens=False)]


def stored(text):
    changes = prefix_tokens.table().changes([text])[0]
    assert len(changes) == 2 * len(text)
    return np.cumsum(np.frombuffer(changes, "<i2")).tolist()


@pytest.mark.parametrize("text", [
    "", "hello world", "we're they've I'll don't I'm he'd", "x're", "!'re ''s 'S", "é École", "İstanbul ŉ", "a<|endoftext|>b", "!!<|endoftext|>!!", "<|endoftext|><|startoftext|>", "<|endo",
    "漢字かな交じり文、テスト。", "हिन्दी में", "ไทยภาษา", "한국어 한", "a b c", "😍😍😍😍x", "\x00\x0b\x0c\x1f", "ạ́̇b", "ΣΑΣ Σ", "ǅ ǆ", "!" * 40, "Ⅷ ² ½ 1٣", "ﬁ ſ K", "'ré", "-" * 300 + "z" * 300,
])
def test_every_prefix_is_counted_as_the_library_counts_it(text):
    assert stored(text) == library_counts(text)


def test_prefixes_of_random_texts():
    rng = random.Random(5)
    pools = ["abcdefghij ETAOIN", "aé'rsvel!<|>endoftx ", "̣́aeo漢字 .'re", "0123٣४ ab", "각ᆧ x", "กขคั่ ्क", "  \t\n ab"]
    for _ in range(1200):
        pool = rng.choice(pools) + rng.choice(pools)
        text = "".join(rng.choice(pool) if rng.random() < 0.96 else rng.choice(["<|endoftext|>", "'re", "'ll", "<|startoftext|>"]) for _ in range(rng.randint(0, 25)))
        assert stored(text) == library_counts(text), text
    for _ in range(1200):
        text = "".join(chr(rng.choice([rng.randrange(1, 0x3000), rng.randrange(1, 0xD800), rng.randrange(0xE000, 0x30000)])) for _ in range(rng.randint(1, 10)))
        assert stored(text) == library_counts(text), ascii(text)


def test_small_tables_change_nothing(monkeypatch):
    monkeypatch.setattr(prefix_tokens, "MAX_PAIRS", 50)
    t = prefix_tokens.PrefixTable(max_words=10)
    texts = ["some words that are said again", "other words that follow them", "some words again"] * 3
    assert t.changes(texts) == prefix_tokens.table().changes(texts)


def test_prefix_token_query(spark, sf):
    docs = {r["doc_id"]: r["text"] or "" for r in rows(spark.read.parquet(f"{sf}/documents.parquet"))}
    encode = prefix_tokens.table().library.encode
    got = rows(queries.op12_prefix_tokens(spark, sf))
    assert len(got) == len(docs)
    for r in got:
        text = docs[r["doc_id"]]
        n = len(encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 2048)
        k = r["kept_chars"]
        assert len(encode(text[:k], add_special_tokens=False).ids) <= 2048 and (k == len(text) if n <= 2048 else len(encode(text[: k + 1], add_special_tokens=False).ids) > 2048)


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    made = [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "xx", "a"), (4, long, "en", None), (5, "one", "de", "b"), (5, "one", "de", "b"), (6, "holds <S> a mark", "en", "b"), (7, "Straße, ünd 漢字 — 5.", "en", "b"), (None, "no id at all in this row", "fr", "c")]
    t = spark.createDataFrame([(*r, len(r[1] or "")) for r in made], DOCS)
    for c in ("_row", "_fim", "_key", "_text", "_bytes", "n_bytes", "n_tokens", "n", "form", "output"):
        t = t.withColumn(c, F.lit("clash"))
    return t


def test_prefix_store_of_odd_rows(spark, odd):
    held = prefix_tokens.prefix_store(odd)
    encode = prefix_tokens.table().library.encode
    want = sorted((str(r["doc_id"]), len(encode(r["text"] or "", add_special_tokens=False).ids)) for r in rows(odd))
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in rows(held)) == want
    asked = held.where("doc_id = 4").select(prefix_tokens.stored_tokens(F.col("changes"), F.lit(5000)).alias("n"), prefix_tokens.stored_cut(F.col("changes"), F.lit(100)).alias("k")).first()
    text = " ".join(f"w{i}" for i in range(60_000))
    assert asked["n"] == len(encode(text[:5000], add_special_tokens=False).ids)
    assert len(encode(text[: asked["k"]], add_special_tokens=False).ids) <= 100 < len(encode(text[: asked["k"] + 1], add_special_tokens=False).ids)
    assert rows(prefix_tokens.budget_answers(spark.createDataFrame([], DOCS))) == []
    with pytest.raises(ValueError):
        prefix_tokens.longest_within(b"", -1)


# ---- 13


def filled(doc_id, text):
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n, h = len(units), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle_query(spark, sf):
    docs = {r["doc_id"]: r["text"] or "" for r in rows(spark.read.parquet(f"{sf}/documents.parquet"))}
    got = rows(queries.op13_fim_streaming(spark, sf))
    assert len(got) == len(docs) and {r["form"] for r in got} == {"plain", "psm", "spm"}
    for r in got:
        n, form, p, m, out = filled(r["doc_id"], docs[r["doc_id"]])
        assert r == {"doc_id": r["doc_id"], "n": n, "form": form, "prefix_chars": p, "middle_chars": m, "output_sha256": sha(out), "restored_sha256": sha(docs[r["doc_id"]])}


def test_fill_in_middle_of_odd_rows(spark, odd):
    got = fill_middle.transform(odd).select("_row.doc_id", F.coalesce("_row.text", F.lit("")).alias("text"), "_row.form", "_fim", fill_middle.restored(F.col("_fim.output"), F.col("_fim.form")).alias("back"))
    for r in rows(got):
        assert tuple(r["_fim"].values()) == filled(r["doc_id"], r["text"]) and r["back"] == r["text"] and r["form"] == "clash"
    assert got.count() == odd.count()
    assert rows(fill_middle.transform(spark.createDataFrame([], DOCS))) == []


def test_parts_meet_without_a_false_mark(spark):
    """Texts whose parts end and begin with pieces of marks are rebuilt."""
    texts = ["<<S<P<M", "S>P>M>", "<P<S>"[:4], "<S<S", ">S>", "<", "M>a<P", "<M<M<M"]
    made = [(k, t) for k in range(60) for t in texts]
    t = fill_middle.transform(spark.createDataFrame(made, "doc_id long, text string"))
    for r in rows(t.select("_row.text", fill_middle.restored(F.col("_fim.output"), F.col("_fim.form")).alias("back"))):
        assert r["text"] == r["back"]


def test_second_pass_reads_no_further_than_the_later_border():
    text = "ab 1 cd" + "\U0001d400" * 3 + "e"
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    for a in range(len(units) + 1):
        for b in range(a, len(units) + 1):
            assert fill_middle.borders(text, a, b) == (len("".join(units[:a])), len("".join(units[:b])))
