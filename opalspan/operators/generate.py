"""Seeded rows of labelled values: telephones, cards, numbers, dates of birth, ages, look-alikes that fail their check."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Reserved or fictional ranges only.
GIVEN = "Ada Ben Cleo Dan Eve Finn Gia Hal Ivy Jon Kim Leo".split()
FAMILY = "Marsh Stone Rivers Field Hall Wood Lake Hill Banks Moor".split()
WORDS = "zero one two three four five six seven eight nine".split()


def luhn_digit(body: str) -> str:
    total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(body))))
    return str(-total % 10)


def value(kind: str, r: random.Random) -> str:
    n = lambda k: "".join(r.choices("0123456789", k=k))
    if kind == "phone":
        tail = f"01{n(2)}"
        return r.choice([f"(415) 555-{tail}", f"415-555-{tail}", f"+1 415 555 {tail}", f"020 7946 0{n(3)}", f"+44 20 7946 0{n(3)}", f"+91 98765 {n(5)}", f"415.555.{tail}", " ".join(WORDS[int(c)] for c in f"415555{tail}")])
    if kind == "card":
        body = r.choice(["4000", "5100", "6011"]) + n(11)
        number = body + luhn_digit(body)
        return r.choice([number, "-".join(number[i : i + 4] for i in range(0, 16, 4)), " ".join(number[i : i + 4] for i in range(0, 16, 4))])
    if kind == "lookalike":
        body = r.choice(["4000", "6034"]) + n(11)
        return body + str((int(luhn_digit(body)) + r.randint(1, 9)) % 10)
    if kind == "ssn":
        return f"9{n(2)}-{n(2)}-{n(4)}"
    if kind == "nino":
        return f"QQ{n(6)}C"
    if kind == "dob":
        y, m, d = r.randint(1940, 2005), r.randint(1, 12), r.randint(1, 28)
        return r.choice([f"{y}-{m:02d}-{d:02d}", f"{d:02d}/{m:02d}/{y}", f"{d} {'Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec'.split()[m - 1]} {y}"])
    if kind == "age":
        return r.choice(["{}", "{} years old", "aged {}"]).format(r.randint(18, 90))
    if kind == "email":
        return f"{r.choice(GIVEN).lower()}.{r.choice(FAMILY).lower()}{n(2)}@example.com"
    return f"{r.choice(['Dr', 'Ms', 'Mr'])} {r.choice(GIVEN)} {r.choice(FAMILY)}"


KINDS = {"phone": "TELEPHONENUM", "card": "CREDITCARDNUMBER", "ssn": "SOCIALNUM", "nino": "SOCIALNUM", "dob": "DATE", "age": "AGE", "email": "EMAIL", "person": "NAME", "lookalike": ""}


def generated(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """(id, text, label, value, start, end): message k depends on the seed and k alone, whatever the partitions. A
    look-alike has no label."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k in b["id"]:
                r = random.Random(f"{seed}-{k}")
                kind = r.choice(list(KINDS))
                v = value(kind, r)
                text = r.choice(["Hello, here it is: {}. Thanks.", "My details are {} as asked.", "Please note {} for the file."])
                at = text.index("{}")
                rows.append((int(k), text.format(v), KINDS[kind], v, at, at + len(v)))
            yield pd.DataFrame(rows, columns=["id", "text", "label", "value", "start", "end"])

    return spark.range(n).mapInPandas(run, "id long, text string, label string, value string, start int, end int")
