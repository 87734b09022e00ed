"""Entity resolution in reading order against a fold, person by person."""

import random

import pytest

from lectern.operators import reading_order

PEOPLE = "book_id string, turn long, ref string, names array<struct<name:string>>"


def fold(people, names):
    out = {}
    for book in {p[0] for p in people}:
        owned = {}
        for b, i, name in names:
            if b == book:
                owned.setdefault(i, set()).add(name.strip().lower())
        known = max(owned, default=0)
        last = known
        for _, turn, ref, told in sorted((p for p in people if p[0] == book), key=lambda p: p[1]):
            told = [n for (n,) in told if n.strip()]
            number = int(ref[1:]) if ref and ref[0] == "c" and ref[1:].isdigit() else None
            who, new = (number if number in owned else None), False
            for name in told if who is None else []:
                owners = [i for i, held in owned.items() if name.strip().lower() in held]
                if " " in name.strip() and len(owners) == 1:
                    who = owners[0]
                    break
            if who is None and told:
                last += 1
                who, new = last, True
            if who is not None:
                owned.setdefault(who, set()).update(n.strip().lower() for n in told)
            out[book, turn] = (who, new)
    return out


def got(spark, people, names, path):
    told = spark.createDataFrame(people, PEOPLE).withColumnRenamed("turn", "turn")
    known = spark.createDataFrame(names, "book_id string, character_id long, name string")
    return {(r.book_id, r.turn): (r.character_id, r.is_new) for r in reading_order.resolved(told, known, "turn", path).collect()}


def test_one_new_person_told_twice_is_one(spark, tmp_path):
    names = [("b", i, f"Known {i}") for i in range(1, 8)]
    people = [("b", 0, "n1", [("Ana Ruiz",)]), ("b", 1, "n1", [("Ana Ruiz",), ("La Rubia",)]), ("b", 2, "n1", [("la rubia",)]), ("b", 3, "c8", [("Anita",)]), ("b", 4, "n2", [("Rubia",)]), ("c", 0, "", [("Ana Ruiz",)])]
    assert got(spark, people, names, f"{tmp_path}/t") == {("b", 0): (8, True), ("b", 1): (8, False), ("b", 2): (8, False), ("b", 3): (8, False), ("b", 4): (9, True), ("c", 0): (1, True)}


@pytest.mark.parametrize("seed", range(4))
def test_equals_a_fold(spark, tmp_path, seed):
    rng = random.Random(seed)
    pool = [f"{a} {b}" for a in ("Ana", "Bo", "Cy") for b in ("Ruiz", "Sol", "Tau")] + ["Ana", "Bo", " ", ""]
    names = [(b, rng.randrange(1, 6), rng.choice(pool[:9])) for b in "xyz" for _ in range(5)]
    people = []
    for book in "wxyz":
        for turn in rng.sample(range(200), 40):
            ref = rng.choice(["n1", "", "c2", f"c{rng.randrange(1, 30)}", "cx", None])
            people.append((book, turn, ref, [(rng.choice(pool),) for _ in range(rng.randrange(0, 3))]))
    assert got(spark, people, names, f"{tmp_path}/t") == fold(people, names)


def test_a_name_told_very_often_needs_few_rounds(spark, tmp_path):
    people = [("b", t, "", [("Ana Ruiz",)]) for t in range(500)]
    found = got(spark, people, [("b", 3, "Otra Persona")], f"{tmp_path}/t")
    assert set(found.values()) == {(4, True), (4, False)} and found["b", 0] == (4, True)


@pytest.mark.parametrize("first, growth", [(3, 2), (8, 3)])
def test_stretches_change_nothing(spark, tmp_path, monkeypatch, first, growth):
    monkeypatch.setattr(reading_order, "FIRST", first)
    monkeypatch.setattr(reading_order, "GROWTH", growth)
    rng = random.Random(first)
    pool = [f"{a} {b}" for a in ("Ana", "Bo", "Cy") for b in ("Ruiz", "Sol")] + ["Ana", " "]
    names = [(b, rng.randrange(1, 4), rng.choice(pool[:6])) for b in "xy" for _ in range(3)]
    people = [(b, t, rng.choice(["n1", "c2", f"c{rng.randrange(1, 20)}"]), [(n,) for n in rng.sample(pool, rng.randrange(0, 3))]) for b in "xyz" for t in range(25)]
    assert got(spark, people, names, f"{tmp_path}/t") == fold(people, names)
