"""Operators that judge or count each text by itself: tokens, quality, secrets."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm import quality, secret_scan, token_counts

from .conftest import texts_of

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def test_token_counts_are_the_librarys(with_null_key):
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    rows = [(r.doc_id, r.text or "") for r in with_null_key.collect()]
    expected = sorted(((d is None, d), len(t.encode()), len(tokenizer.encode(t, add_special_tokens=False).ids)) for d, t in rows)
    found = token_counts.count_tokens(with_null_key, BYTE_BPE).collect()
    assert sorted(((r.doc_id is None, r.doc_id), r.n_bytes, r.n_tokens) for r in found) == expected


def test_token_counts_do_not_depend_on_the_table(messy):
    without = token_counts.count_tokens(messy, BYTE_BPE, frequent={}).collect()
    assert sorted(map(tuple, without)) == sorted(map(tuple, token_counts.count_tokens(messy, BYTE_BPE).collect()))


def test_texts_are_cut_where_the_library_cuts():
    rng = random.Random(3)
    alphabet = [*"abXY09 .,'!\n\t\r|<>-éßñÉ×÷", "ſ", "K", "中", "́", " ", " ", "\x1c", "\x85", "​", "🙂"]
    alphabet += ["<|endoftext|>", "'s", "'RE", " 'll", "  ", "\n\n"]
    encoder = token_counts.Encoder.of(BYTE_BPE)
    for _ in range(4000):
        text = "".join(rng.choices(alphabet, k=rng.randint(1, 12)))
        whole = len(encoder.tokenizer.encode(text, add_special_tokens=False).ids)
        assert sum(encoder.lengths(encoder.cutter.cut(text))) == whole, repr(text)


def test_token_counts_of_nothing(nothing):
    assert token_counts.count_tokens(nothing, BYTE_BPE).collect() == []


def measures(text: str) -> tuple:
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    repeated = {i + k for i, win in enumerate(windows) if times[win] > 1 for k in range(5)}
    failed = len(words) < 10 or 100 * len(repeated) > 20 * len(words)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    chars = sum(map(len, words))
    letters = re.findall(r"[A-Za-z]", text)
    other = (
        5 * symbols > 2 * len(words)
        or 10 * (len(lines) - len(set(lines))) > 3 * len(lines)
        or chars < 2 * len(words)
        or chars > 20 * len(words)
        or 10 * sum(c.isupper() for c in letters) > 6 * len(letters)
    )
    return len(words), chars, symbols, len(lines) - len(set(lines)), len(repeated), failed, not (failed or other)


def test_quality_measures(messy):
    found = {r.doc_id: tuple(r)[1:] for r in quality.quality_measures(messy).collect()}
    assert found == {doc: measures(text) for doc, text in texts_of(messy).items()}


def test_quality_of_rows_without_a_key_and_repeated_rows(spark, with_null_key):
    rows = [(r.doc_id, r.text) for r in with_null_key.select("doc_id", "text").collect()]
    keyed = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    by_row = {r.doc_id: tuple(r)[1:] for r in quality.quality_measures(keyed).collect()}
    found = sorted(map(str, (tuple(r) for r in quality.quality_measures(with_null_key).collect())))
    assert found == sorted(str((k, *by_row[i])) for i, (k, _) in enumerate(rows))


def test_quality_verdict_is_the_same_in_any_order(spark, messy):
    rows = [(100, "| a b c | " * 20, None), (101, "SHOUTING WORDS ALL " * 3 + "OF DIFFERENT KINDS HERE NOW", None)]
    docs = messy.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string, x string").drop("x"))
    found = {r.doc_id: r for r in quality.quality_verdicts(docs).collect()}
    other_way = {r.doc_id: r.kept for r in quality.quality_verdicts(docs, tuple(reversed(quality.RULES)), sample_texts=3).collect()}
    assert {d: r.kept for d, r in found.items()} == other_way
    assert other_way == {d: measures(t)[-1] for d, t in texts_of(docs).items()}
    assert all((r.rejected_by is None) == r.kept for r in found.values())


def test_rules_run_by_rejections_per_second_and_short_circuit():
    slow, fast = quality.Rule("slow", lambda t: t.words.counts < 3), quality.Rule("fast", lambda t: t.words.counts < 3)
    estimates = {"slow": (0.5, 1.0), "fast": (0.4, 0.1)}
    assert [r.name for r in quality.cascade_order(estimates, (slow, fast))] == ["fast", "slow"]
    asked = []

    def recorded(texts):
        asked.append(len(texts))
        return texts.words.counts < 3

    import pyarrow as pa

    texts = quality.Texts(pa.array(["a", "a b c d", "b"]))
    by = quality.run_cascade(texts, [quality.Rule("one", recorded), quality.Rule("two", recorded)])
    assert by.tolist() == [0, -1, 0] and asked == [3, 1]


def test_quality_of_nothing(nothing):
    assert quality.quality_measures(nothing).collect() == []


KEY = "AKIA" + "Q7" * 8
SECRETS = {
    1: 'Password: "hunter22x" and token=short api-key=abcdefgh',
    2: f"é {KEY} x{KEY}Z {'0f' * 12} {'ab' * 11}",
    3: "API_KEY = 'abc123' secret:=zzzzzzz ſecret=abcdefgh toKen=abcdefgh",
    4: "token = " + "9f" * 20,
    5: None,
    6: "token = " + "9f" * 20,
}


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    assign = r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = [(m.start(), 0, "assign", m.end()) for m in re.finditer(assign, text) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_secret_spans(spark, tmp_path):
    docs = spark.createDataFrame([*SECRETS.items(), (None, SECRETS[1])], "doc_id long, text string")
    found = secret_scan.scan(docs, str(tmp_path / "ledger")).collect()
    assert len(found) == 7
    for r in found:
        text = SECRETS[r.doc_id] if r.doc_id else SECRETS[1]
        assert [(f.kind, f.start_at, f.end_at) for f in r.findings] == [(k, s, e) for s, _, k, e in base_spans(text or "")]
        assert r.blob == hashlib.sha256((text or "").encode()).hexdigest()


def test_ledger_reads_a_blob_once_for_each_rule_version(spark, tmp_path):
    path, rules = str(tmp_path / "ledger"), secret_scan.RULES[:3]
    docs = spark.createDataFrame(list(SECRETS.items()), "doc_id long, text string")
    texts = docs.selectExpr("doc_id", "coalesce(text, '') AS text").withColumn("blob", secret_scan.blob_id())

    def unseen(rules):
        return {(r.text, tuple(sorted(r.to_run))) for r in secret_scan.unseen_pairs(texts, secret_scan.read_ledger(spark, path), rules).collect()}

    ids = tuple(sorted(r.id for r in rules))
    assert unseen(rules) == {(t or "", ids) for t in SECRETS.values()}
    first = secret_scan.scan(docs, path, rules).collect()
    assert unseen(rules) == set()
    newer = (*rules[:2], rules[2]._replace(version=2))
    assert unseen(newer) == {(t or "", ("hex@2",)) for t in SECRETS.values()}
    again = secret_scan.scan(docs, path, newer).collect()
    assert sorted(map(str, again)) == sorted(map(str, first))
    assert sorted(map(str, secret_scan.scan(docs, path, newer).collect())) == sorted(map(str, first))


def test_secrets_of_nothing(nothing, tmp_path):
    assert secret_scan.scan(nothing, str(tmp_path / "ledger")).collect() == []


@pytest.mark.parametrize("kind", ["pem", "web_token"])
def test_further_rules(kind):
    rule = {r.kind: r for r in secret_scan.RULES}[kind]
    text = {"pem": "x -----BEGIN RSA PRIVATE KEY-----\nMIIab+/=\n-----END RSA PRIVATE KEY----- y", "web_token": "a eyJhbGciOiJIUz.eyJzdWIiOiIxMg.abcdefghij-_ b"}
    assert list(rule.spans(text[kind])) == [(2, len(text[kind]) - 2)]
    assert list(rule.spans("plain words")) == []


def test_private_keys_with_header_lines_and_escaped_line_ends():
    rule = {r.kind: r for r in secret_scan.RULES}["pem"]
    begin, end = "-----BEGIN EC PRIVATE KEY-----", "-----END EC PRIVATE KEY-----"
    locked = f"{begin}\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A1B\n\nMIIab+/=\n{end}"
    escaped = begin + r"\nMIIab+/=\nMIIcd\n" + end
    text = f"a {locked} b {escaped} c"
    assert [text[s:e] for s, e in rule.spans(text)] == [locked, escaped]
    assert list(rule.spans(f"{begin} not (closed) {end}")) == []


def test_a_second_scan_moves_no_text(spark, tmp_path):
    path = str(tmp_path / "ledger")
    long = "x" * 300_000 + " token=abcdef123 " + "é" * 100_000
    docs = spark.createDataFrame([(1, "password: hunter22", "b"), (2, long, "c"), (2, long, "d"), (None, None, "e")], "doc_id long, text string, blob string")
    docs = docs.withColumns({"findings": F.lit(1), "rules": F.lit(2), "to_run": F.lit(3)})
    first = sorted(map(str, secret_scan.scan(docs, path).collect()))
    texts = docs.select(secret_scan.blob_id().alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    again = secret_scan.unseen_pairs(texts, secret_scan.read_ledger(spark, path))
    assert again.collect() == []
    plan = again._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and plan.count("Exchange hashpartitioning") == 1  # of the joined rows, none
    assert sorted(map(str, secret_scan.scan(docs, path).collect())) == first
    assert [f.start_at for r in secret_scan.scan(docs, path).collect() if r.doc_id == 2 for f in r.findings] == [300_001] * 2


def test_web_tokens_after_a_word_character(spark, tmp_path):
    token = "eyJhbGciOiJIUz.eyJzdWIiOiIxMg.abcdefghij-_"
    texts = [f"a%20{token}", f"a%3D{token}", "a\\n" + token, f"a_{token}", token]
    found = secret_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), str(tmp_path / "ledger")).collect()
    spans = {r.doc_id: [(f.start_at, f.end_at) for f in r.findings if f.kind == "web_token"] for r in found}
    assert spans == {i: [(t.index("eyJ"), len(t))] for i, t in enumerate(texts)}
