"""Fill-in-middle against a plain version, with nulls, odd white space, marks, long texts and clashing columns."""

import hashlib
import random
import re
from collections import Counter

from tessera.llm import fill_in_middle

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, id string, n int, form string, h1 int"


def plain_version(i, text, rate=50):
    text = text or ""
    u = UNIT.findall(text)
    h = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    r = [int(h[8 * k:8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(u) + 1) for x in r[:2])
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or re.search("<[PSM]>", text) or r[2] % 100 >= rate:
        return i, len(u), "plain", None, None, text, text
    if r[3] % 100 < 80:
        return i, len(u), "spm", p, m, f"<S>{s}<P>{p}<M>{m}", text
    return i, len(u), "psm", p, m, f"<P>{p}<S>{s}<M>{m}", text


def rows():
    rng = random.Random(3)
    signs = ["a", "é", "ß", "漢", " ", " ", " ", "\n", "\t", "\x0b", "\x0c", "\r", "<", ">", "<P", "P>", "<S", "M>", "\x1c", " ", "\x00"]
    made = [(k, "".join(rng.choices(signs, k=rng.randint(0, 60)))) for k in range(400)]
    made += [(1000 + k, f"x <{'PSM'[k % 3]}> y") for k in range(9)] + [(None, "a b c d"), (None, None), (2000, None), (2001, ""), (2002, " \n")]
    return made + [(3000 + k, "wörd " * 60_000 + "end") for k in range(6)] + made[:3]


def test_every_form_equals_the_plain_version_and_is_read_back(spark):
    data = rows()
    docs = spark.createDataFrame([(i, t, "x", 1, "f", 2) for i, t in data], SCHEMA).repartition(3)
    for rate in (50, 100):
        out = fill_in_middle.fill_in_middle(docs, rate=rate)
        out = out.withColumn("back", fill_in_middle.restored(out["output"], out["form"]))
        got = Counter(map(tuple, out.collect()))
        assert got == Counter(plain_version(i, t, rate) for i, t in data)
        assert {r[2] for r in got} == {"plain", "spm", "psm"}


def test_empty_table_and_ids_of_other_types(spark):
    assert fill_in_middle.fill_in_middle(spark.createDataFrame([], SCHEMA)).collect() == []
    out = fill_in_middle.fill_in_middle(spark.createDataFrame([("k7", "a b c")], "doc_id string, text string")).first()
    assert tuple(out)[:2] == ("k7", 3) and out["output"] == plain_version("k7", "a b c")[5]
