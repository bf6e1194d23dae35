"""Small tables with awkward rows for the text operators."""

from __future__ import annotations

import random

import duckdb
import pandas as pd

VOCABULARY = [f"w{k}" for k in range(400)] + ["the", "of", "and", "to", "in"] * 20


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def changed(rng: random.Random, text: str, n: int) -> str:
    words = text.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def texts() -> list[str | None]:
    rng = random.Random(5)
    base = sentence(rng, 150)
    passage = "\n".join(sentence(rng, 20) for _ in range(4))
    item = sentence(rng, 40)
    out: list[str | None] = [None, "", " \n\t ", "one", "two words", "a b c", "A b C", "a  b\tc", "é ü 🙂  x"]
    out += [base] * 25 + [changed(rng, base, rng.randrange(1, 12)) for _ in range(60)]
    out += [f"{sentence(rng, 60)}\n{passage}\n\n{sentence(rng, 30)}" for _ in range(6)]
    out += [passage, passage.replace("\n", "\n\n"), f"{passage}\n{passage}"]
    out += [f"{sentence(rng, 50)} {item.upper()} {sentence(rng, 50)}", item, item.replace(" ", "\n", 3)]
    out += [" ".join(item.split()[:34] + ["x"] + item.split()[35:]), " ".join(item.split()[:20])]
    out += [sentence(rng, 6000), "same " * 3000, "x" * 30000, "1" * 5000, "a@" * 2000]
    out += ["# $ | " * 40, "Same line here\n" * 12, "ab ! " * 30, sentence(rng, 12) + " ..."]
    out += [
        "mail a.b+c@d-e.example.org, or x@y; 1.2.3.4 and 999.1.1.1 and 1.2.3.4.5.6.7.8",
        "call +1 (980) 555-6268 97.51.17.173 or +44 20 7946 0958, not +1 2",
        "card 4111 1111 1111 1111 and 4111-1111-1111-1112 and 98079157628",
        "a@b.c%d@e.f 4111111111111111 é 🙂 z@z.zz",
    ]
    out += [sentence(rng, rng.randrange(5, 120)) for _ in range(40)]
    return out


def documents() -> pd.DataFrame:
    own = texts()
    frame = pd.DataFrame({"doc_id": range(10, 10 + len(own)), "text": own, "lang": "en", "source": "s"})
    frame["n_chars"] = [len(t or "") for t in own]
    return frame


def benchmark() -> pd.DataFrame:
    rng = random.Random(5)
    sentence(rng, 150)
    for _ in range(4):
        sentence(rng, 20)
    item = sentence(rng, 40)
    return pd.DataFrame(
        {"item_id": range(7), "text": [item, None, "", "one", "two words", item + " w1 w2", "nowhere to be found at all here"]}
    )


def write(folder, **tables: pd.DataFrame) -> str:
    for name, frame in tables.items():
        frame.to_parquet(f"{folder}/{name}.parquet")
    return str(folder)


def connect(folder: str, *names: str):
    con = duckdb.connect()
    for name in names:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con
