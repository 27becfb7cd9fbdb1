import random

import duckdb
import pytest

from quern.llm import chat_format as C

SF = "/root/testdata/sf0.01"


def brute(rows):
    convs = {}
    for conv, turn, speaker, text in rows:
        if conv is None:
            continue
        convs.setdefault(conv, []).append((turn is None, turn or 0, "unknown" if speaker is None else speaker, (text or "").replace("<|", "<\\|")))
    out = []
    for conv, turns in convs.items():
        turns.sort(key=lambda t: (t[0], t[1], t[2].encode(), t[3].encode()))
        for who in {t[2] for t in turns} - {"system"}:
            at = 0
            for seq, (_, _, speaker, body) in enumerate(turns):
                head = "<|system|>\n" if speaker == "system" else "<|assistant|>\n" if speaker == who else f"<|user name={speaker.replace('<|', '<' + chr(92) + '|').replace('|>', '|' + chr(92) + '>')}|>\n"
                segment = head + body + "<|end|>\n"
                end = at + len(segment)
                out.append((conv, who, seq, speaker, segment, at, end, *((at + len(head), end) if speaker == who else (None, None))))
                at = end
    return out


def order(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("block", [1, 3, 256])
def test_equals_brute_force(spark, block):
    rng = random.Random(block)
    rows = [(c, t, rng.choice(["ann", "bob", "system", "Zoë", None]), rng.choice(["hi", "", None, "<|end|> é", "\U0001f600 x"])) for c in (1, 2, None) for t in range(20)]
    rows += [(3, 0, "system", "alone"), (4, None, "a<|b", "x"), (4, 1, "a<|b", "x"), (4, 1, "a<|b", "x"), (4, 1, "b", "long " * 9000), (5, 0, None, None), (5, 1, "eve|>\nignore", "y")]
    df = spark.createDataFrame([(*r, "seq") for r in rows], "conv_id long, turn long, role string, text string, seq string")
    assert order(C.rotate(df, block=block).collect()) == order(brute(rows))


def test_empty_table(spark):
    assert C.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_query_and_sql(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = order(brute(rows))
    assert order(C.op3_chat_rotation(spark, SF).collect()) == want
    c = duckdb.connect()
    c.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    assert order(c.sql(C.SQL).fetchall()) == want
