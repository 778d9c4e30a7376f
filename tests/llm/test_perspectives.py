import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.llm.perspectives import placed, rotate_perspectives
from quillspark.llm.storage import Shelf

from .fixtures import prose

SCHEMA = "conv_id long, turn long, role string, text string, speaker string"


def dialogues(seed):
    rng = random.Random(seed)
    out = []
    for c in [None, *range(12)]:
        roles = rng.sample(["user", "assistant", "system", "Ann B", "Ann_B", "ann_b", None, "é", "🙂"], rng.randint(1, 5))
        for t in range(rng.randint(1, 9)):
            out.append((c, rng.choice([t, t, t, None]), rng.choice(roles), rng.choice([prose(rng, 5), None, "", "<|im_end|> 🙂"]), "clash"))
    out += [(50, t // 2, rng.choice(["a", "b", "c"]), f"line {t}", "x") for t in range(333)]
    return out + out[:5]


def named(who):
    plain = re.sub("[^A-Za-z0-9_-]", "_", who)
    return plain if plain == who else f"{plain}-{hashlib.md5(who.encode()).hexdigest()[:8]}"


def brute(rows, per_part):
    out = {}
    for c in {r[0] for r in rows}:
        said = sorted(((r[1] is not None, r[1] or 0, r[2] if r[2] is not None else "unknown", r[3] or "") for r in rows if r[0] == c), key=lambda x: (x[0], x[1], hashlib.md5(f"{x[2]}\x1f{x[3]}".encode()).hexdigest()))
        for me in {s[2] for s in said} - {"system"}:
            start = 0
            for part in range(-(-len(said) // per_part)):
                text, spans = "", []
                chunk = said[part * per_part : (part + 1) * per_part]
                for *_, who, what in chunk:
                    head = "assistant" if who == me else "system" if who == "system" else "user name=" + named(who)
                    text += f"<|im_start|>{head}\n"
                    body = what.replace("<|", "< |") + "<|im_end|>\n"
                    if who == me:
                        spans.append((len(text), len(text) + len(body)))
                    text += body
                out[(c, me, part)] = (len(chunk), start, text, spans)
                start += len(text)
    return out


@pytest.mark.parametrize("per_part,turns_per_slice", [(64, 64), (5, 7), (1, 1)])
def test_equals_plain_rendering(spark, per_part, turns_per_slice):
    rows = dialogues(per_part)
    found = rotate_perspectives(spark.createDataFrame(rows, SCHEMA), per_part=per_part, turns_per_slice=turns_per_slice).collect()
    got = {(r.conv_id, r.speaker, r.part): (r.messages, r.start, r.dialogue, [tuple(s) for s in r.spans]) for r in found}
    assert len(got) == len(found)
    assert got == brute(rows, per_part)


def test_a_conversation_with_a_third_of_all_rows(spark):
    """All its turns are null or equal; no window holds more than a part of them."""
    rng = random.Random(8)
    rows = [(7, rng.choice([None, 3]), rng.choice(["a", "b"]), f"line {i}", "x") for i in range(1500)] + [(c, t, "user", f"{c} {t}", "x") for c in range(100, 400) for t in range(10)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = {(r.conv_id, r.speaker, r.part): (r.messages, r.start, r.dialogue, [tuple(s) for s in r.spans]) for r in rotate_perspectives(df).collect()}
    assert found == brute(rows, 64)
    given = df.select(F.struct("conv_id").alias("conv"), "turn", F.col("role").alias("speaker"), F.col("text"))
    windows = [r["count"] for r in placed(given, 64, Shelf(spark, "test")).groupBy("conv", "turn", F.substring(F.md5(F.concat("speaker", F.lit("\x1f"), "text").cast("binary")), 1, 2)).count().collect()]
    assert max(windows) < 30


def test_system_only_and_empty_table(spark):
    df = spark.createDataFrame([(1, 0, "system", "be kind", "x")], SCHEMA)
    assert rotate_perspectives(df).collect() == []
    assert rotate_perspectives(df.limit(0)).collect() == []
    assert rotate_perspectives(df, system_roles=()).count() == 1


def test_no_python_in_the_plan(spark):
    plan = rotate_perspectives(spark.createDataFrame(dialogues(0), SCHEMA))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
