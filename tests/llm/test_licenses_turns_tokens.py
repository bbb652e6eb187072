"""License diagonals, turn repair and token alignment against plain versions."""

import collections
import hashlib
import itertools
import random
import re

import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from tracktally.llm import license_diagonals, token_alignment, turn_repair

A_PATH, B_PATH = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# licenses


def plain_places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text))
    return sorted(
        (i, i + len(p), t.label)
        for t in license_diagonals.PHRASES
        for p in [t.text.split()]
        for i in range(len(words) - len(p) + 1)
        if words[i : i + len(p)] == p
    )


def test_phrases_where_their_words_stand(spark):
    rng = random.Random(1)
    pool = "under the mit license apache version 2 cc by nc É x".split()
    texts = [None, "", "cc by", "Under the MIT-License!", "CC by nc cc BY nc by", "under the mit license under the mit license"]
    texts += [" ".join(rng.choices(pool, k=rng.randrange(60))) for _ in range(150)]
    texts += ["cc by nc " * 500, texts[5], texts[5]]
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts)] + [(5, texts[5])] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = license_diagonals.scan_licenses(docs).collect()
    made = collections.Counter((r.doc_id, tuple((s.start, s.end, s.label) for s in r.spans if s.phrase)) for r in got)
    assert made == collections.Counter((i, tuple(plain_places(t or ""))) for i, t in rows)
    assert license_diagonals.scan_licenses(docs.limit(0)).collect() == []


def test_notices_with_words_put_in_left_out_and_changed(spark):
    notice = next(t for t in license_diagonals.NOTICES if t.label == "bsd").text.split()
    edited = notice[:5] + ["new", "words"] + notice[5:9] + notice[10:15] + ["other"] + notice[16:]
    texts = [" ".join(["a"] * 7 + notice + ["b"]), " ".join(edited), " ".join(notice[::-1]), " ".join(notice[:8])]
    twice = " ".join(notice + ["and"] * 40 + edited)
    docs = spark.createDataFrame(list(enumerate([*texts, twice])), "doc_id long, text string")
    found = {r.doc_id: r.spans for r in license_diagonals.scan_licenses(docs).collect()}
    assert [(s.label, s.start, s.end, s.score) for s in found[0]] == [("bsd", 7, 7 + len(notice), 1.0)]
    assert [(s.label, s.start) for s in found[1]] == [("bsd", 0)] and 0.5 <= found[1][0].score < 1
    assert found[2] == [] and found[3] == []
    assert len(found[4]) == 2


# turns


def fault_of(seen, role, text):
    if not re.search(r"[^\x20\x09-\x0D]", text):
        return 1
    if (role, text) in seen:
        return 2
    return 0 if re.search(r"[.!?][\x20\x09-\x0D]*\Z", text) else 3


def plain_repair(turns):
    """Every way through the turns by exhaustive search; fit for a few turns only."""
    seen, faults = set(), []
    for role, text in turns:
        faults.append(fault_of(seen, role, text))
        seen.add((role, text))
    best = None

    def go(k, cost, audit, said):
        nonlocal best
        if best and cost > best[0]:
            return
        initials = "".join(r[:1] or "-" for r, _ in said)
        if not re.fullmatch(r"s?(ua)*u?", initials):
            return
        if k == len(turns) and re.fullmatch(r"(s?(ua)+)?", initials):
            best = min(x for x in (best, (cost, audit, said)) if x)
        if not audit.endswith("II"):
            for role in ("user", "assistant"):
                go(k, cost + 2, audit + "I", [*said, (role, "")])
        if k < len(turns):
            role, text = turns[k]
            go(k + 1, cost + 3, audit + "D", said)
            if faults[k] in (0, 3):
                more = int(faults[k] == 3)
                go(k + 1, cost + more, audit + "K", [*said, (role, text)])
                for to in ("user", "assistant"):
                    go(k + 1, cost + 2 + more, audit + "R", [*said, (to, text)])

    best = (3 * len(turns), "D" * len(turns), [])
    go(0, 0, "", [])
    initials = [r[:1] for r, _ in turns]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    return (faults.count(1), faults.count(2), faults.count(3), illegal, best[0], best[1], sha("\n".join(f"{r}:{t}" for r, t in best[2])))


def conversations(rng, n, most):
    roles = ["user", "assistant", "user", "assistant", "system", " ", "tool", ""]
    texts = ["One.", "Two!", "cut", " ", "", "Three?\n", "Ü"]
    return [[(rng.choice(roles), rng.choice(texts)) for _ in range(rng.randrange(1, most))] for _ in range(n)]


@pytest.mark.parametrize("piece", [2, 1000])
def test_repairs_equal_an_exhaustive_search(spark, piece):
    made = conversations(random.Random(3), 60, 6)
    rows = [(i if i else None, k, r, t) for i, turns in enumerate(made) for k, (r, t) in enumerate(turns)]
    turns = spark.createDataFrame(rows, "conv long, turn long, role string, text string").repartition(4)
    got = turn_repair.summarise(turn_repair.repair_turns(turns, piece)).collect()
    fields = ("blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    found = {r.conv or 0: tuple(r[f] for f in fields) for r in got}
    assert found == {i: plain_repair(t) for i, t in enumerate(made)}


def test_pieces_do_not_change_a_long_conversation(spark):
    rng = random.Random(5)
    rows = [(7, k, rng.choice(["user", "assistant", "system"]), f"{rng.randrange(300)}{rng.choice('.!x')}") for k in range(700)]
    turns = spark.createDataFrame(rows, "conv long, turn long, role string, text string")
    repaired = {p: turn_repair.repair_turns(turns, p) for p in (9, 250, 1000)}
    whole = {p: turn_repair.summarise(r).collect() for p, r in repaired.items()}
    assert whole[9] == whole[250] == whole[1000] and len(whole[9]) == 1
    said = turn_repair.repaired_rows(repaired[9]).orderBy("seq", "at").collect()
    assert sha("\n".join(f"{r.role}:{r.text}" for r in said)) == whole[9][0].repaired_sha256
    assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in said))


def test_conversations_with_nulls_ties_and_no_rows(spark):
    rows = [(None, None, None, None), (1, None, "user", "A."), (1, None, "user", "A."), (1, 3, "user", "A."), (1, 9, "assistant", "B.")]
    rows += [(2, k, "user", "Long. " * 20_000) for k in range(3)]
    schema = "conv_id long, turn long, role string, text string, conv int, seq int, gaps int, `a.b` int"
    table = spark.createDataFrame([r + (None,) * 4 for r in rows], schema)
    got = {r.conv: r for r in turn_repair.audit_conversations(table).collect()}
    assert set(got) == {None, 1, 2}
    assert turn_repair.audit_conversations(table.limit(0)).collect() == []
    plain = turn_repair.repair_turns(table.where("conv_id = 1").select(F.col("conv_id").alias("conv"), "turn", "role", "text"))
    only = turn_repair.summarise(plain).collect()[0]
    assert (only.duplicate, only.audit, only.cost) == (2, "KDDK", 6)
    assert got[1].gaps in (0, 5)


# tokens


@pytest.fixture(scope="module")
def coders():
    a = tokenizers.Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B_PATH)


def plain_alignment(coders, texts):
    a, b = coders
    letters = {chr(c): c for c in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    rest = [c for c in range(256) if chr(c) not in letters]
    letters |= {chr(256 + i): c for i, c in enumerate(rest)}
    names = {i: t for t, i in a.get_vocab().items()}
    docs = []
    for text in texts:
        ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        spelled = [bytes(letters[c] for c in names[i]) for i in ids[0]], []
        for i in ids[1]:
            p = b.id_to_piece(i)
            spelled[1].append(bytes([int(p[3:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode())
        if not text or any(b"".join(s) != (" " + text).encode() for s in spelled):
            docs.append(None)
            continue
        ends = [list(itertools.accumulate(map(len, s))) for s in spelled]
        starts = [[0, *e[:-1]] for e in ends]
        linked = [
            (i, j) for i in range(len(ids[0])) for j in range(len(ids[1])) if starts[0][i] < ends[1][j] and starts[1][j] < ends[0][i]
        ]
        groups, low = [], 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            groups.append("|".join(",".join(str(x) for x, e in zip(ids[s], ends[s]) if low < e <= cut) for s in (0, 1)))
            low = cut
        docs.append((ids, [(ids[0][i], ids[1][j]) for i, j in linked], groups))
    total = collections.Counter(p for d in docs if d for p in d[1])
    most = collections.defaultdict(int)
    for (_, y), n in total.items():
        most[y] = max(most[y], n)
    made = []
    for d in docs:
        if d is None:
            made.append((0, 0, 0, 0, 0, 0, ""))
            continue
        ids, linked, groups = d
        best = sum(total[p] == most[p[1]] for p in linked)
        made.append((len(ids[0]), len(ids[1]), len(groups), len(linked), best, sum(total[p] for p in linked), sha(";".join(groups))))
    return made


@pytest.mark.parametrize("chunk", [1, 4_000_000])
def test_alignment_equals_all_pairs(spark, coders, chunk):
    rng = random.Random(2)
    texts = ["", "a", "same text", "same text", "<|endoftext|> <s> <unk> <0x41>", "mark ▁ here", "É😀 \n\n\t x", "zero\0byte", "  two  blanks "]
    pool = "the and über naïve tokenization 12345 word, .  \n <pad> 東京   é".split(" ")
    texts += [" ".join(rng.choices(pool, k=rng.randrange(1, 40))) for _ in range(60)]
    rows = [(i % 50, t or None if i % 2 else t, 1, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, chunk int, pairs string").repartition(3)
    got = token_alignment.align_tokenizers(docs, A_PATH, B_PATH, chunk=chunk).collect()
    fields = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    found = collections.Counter((r.doc_id, *(r[f] for f in fields)) for r in got)
    assert found == collections.Counter((i % 50, *m) for i, m in enumerate(plain_alignment(coders, texts)))


def test_alignment_of_no_rows_and_a_long_text(spark, coders):
    docs = spark.createDataFrame([(None, "long words " * 40_000), (1, None)], "doc_id long, text string")
    assert token_alignment.align_tokenizers(docs.limit(0), A_PATH, B_PATH).collect() == []
    rows = {r.doc_id: r for r in token_alignment.align_tokenizers(docs, A_PATH, B_PATH).collect()}
    assert rows[1].n_a == 0 and rows[1].groups_sha256 == "" and rows[None].n_links >= rows[None].n_groups > 40_000
