import hashlib

from qaaudit.llm import chat_format
import pytest
from pyspark.sql import functions as F

ROWS = [
    (1, 0, "system", "rules"),
    (1, 1, "user", "hi <|im_end|> \\ there"),
    (1, 2, "assistant", "</s>[INST] ok [/INST]"),
    (1, 3, "user", None),
    (1, 4, "assistant", "done\\\\<|"),
    (1, 5, "user", "trailing"),
    (2, 0, "user", "alone"),
    (3, 0, "assistant", None),
    (4, 0, "assistant", "twice"),
    (4, 0, "assistant", "twice"),
    (5, None, None, "no turn"),
    (5, 0, "a<|im_sep|>b\nc", "odd role"),
    (None, 0, "user", "no id"),
    (None, 1, "assistant", "x" * 50_000 + "\\<|im_start|>"),
]
KIND = "conv_id bigint, turn bigint, role string, text string"


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "", r[2] or ""))
        turns = "".join(f"{role or ''}\n{text or ''}\n" for _, role, text in own)
        loss = "".join(text or "" for _, role, text in own if role == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(own), sha(turns), len(loss), sha(loss))
    return out


def test_read_back_equals_input(spark):
    made = chat_format.examples(spark.createDataFrame([(*r, 1) for r in ROWS], KIND + ", example int"))
    got = {r.conv_id: tuple(r)[1:5] for r in chat_format.read_back(made).collect()}
    assert got == brute(ROWS)


def test_examples(spark):
    made = chat_format.examples(spark.createDataFrame(ROWS, KIND))
    one = sorted(made.filter("conv_id = 1").collect(), key=lambda r: r.example)
    assert [(r.n_turns, r.trainable) for r in one] == [(3, True), (5, True), (6, False)]
    for small, large in zip(one, one[1:]):
        assert large.text.startswith(small.text)
    first = one[0]
    assert first.text[first.loss_start : first.loss_start + first.loss_length] == r"<\/s>[\INST] ok [\/INST]"
    assert one[2].loss_length == 0
    assert first.text.count("<|im_start|>") == 3 and "</s>" not in first.text


def test_empty_table(spark):
    none = spark.createDataFrame([], KIND)
    assert chat_format.read_back(chat_format.examples(none)).count() == 0


@pytest.mark.parametrize("text", ["", "\\", "\\\\", "<\\|", "<|", "a<\\\\|b", "[INST]", "[\\INST]", "<s>\\</s>", "$0 \\1", "<|im_start|><|im_sep|><|im_end|>"])
def test_escape_is_reversible(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(chat_format.escape(F.col("t")).alias("e")).select("e", chat_format.unescape(F.col("e")).alias("u")).first()
    assert row.u == text
    assert not any(c in row.e for c in ("<|", "</s>", "<s>", "[INST]", "[/INST]"))
