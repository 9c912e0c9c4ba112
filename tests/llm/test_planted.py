"""Planted cases: works and persons written in many ways, with recall and precision of what is found."""

import random

from tidewrack.llm.groups import link_groups, record_keys
from tidewrack.llm.names import author_pairs


def scored(found, true):
    both = len(found & true)
    return both / len(true), both / max(1, len(found))


def test_works_are_found_again(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgiklmnoprstu") for _ in range(7))
    rows, work = [], {}
    for w in range(60):
        title, doi, page = f"{word()} of {word()} and {word()} {w}", f"10.1234/{word()}", f"{word()}.example/{word()}"
        ways = [  # every next one shares a key with one before it
            (title.upper(), None, None), (f"The {title.replace(' and ', ' & ')}.", f"https://doi.org/{doi.upper()}", None), (None, f"doi:{doi}", f"http://www.{page}/?utm_source=x"), ("Editorial", None, f"https://{page}#top"), ("", None, f"https://doi.example/{doi.replace('/', '%2F')}"),
        ]
        for way in ways[: rng.randrange(1, 6)]:
            rows.append((f"o{len(rows):04d}", *way))
            work[rows[-1][0]] = w
    rng.shuffle(rows)
    got = {r.occurrence_id: r.group_id for r in link_groups(record_keys(spark.createDataFrame(rows, "occurrence_id string, title string, doi string, url string"))).collect()}
    pairs = lambda m: {(a, b) for a in m for b in m if a < b and m[a] == m[b]}
    recall, precision = scored(pairs(got), pairs(work))
    assert recall == 1.0 and precision == 1.0
    assert all(g == min(o for o in got if got[o] == g) for g in got.values())


def test_authors_are_found_again(spark):
    rng = random.Random(13)
    given = [("Robert", "Bob"), ("William", "Bill"), ("Katherine", "Kate"), ("Margaret", "Peggy"), ("Theodore", "Ted"), ("Ingrid", None), ("Haruki", None), ("Solveig", None)]
    surname = lambda: "".join(rng.choice("bdfgklmnprstv") + rng.choice("aeiou") for _ in range(4)).capitalize() + rng.choice(["sen", "lund", "mann"])
    owner, names = {}, set()
    for person in range(80):
        (first, nick), last, mid = rng.choice(given), surname(), rng.choice("ABCDE")
        ways = [f"{last}, {first}", f"{first} {last}", f"{last}, {first} {mid}.", f"{first[0]}. {mid}. {last}", f"{last} {first[0]}{mid}", f"{last.upper()}, {first}", f"{first} {mid}. {last}"]
        ways += [f"{nick} {last}"] * bool(nick)
        k = rng.randrange(2, len(last) - 2)
        ways.append(f"{last[:k]}{last[k + 1]}{last[k]}{last[k + 2 :]}, {first}")  # a slip
        for name in {*ways[:1], *rng.sample(ways, 5)}:
            owner.setdefault(name, set()).add(person)
            names.add(name)
    found = {(r.name_a, r.name_b) for r in author_pairs(spark.createDataFrame([(n,) for n in sorted(names)], "name string")).collect()}
    true = {(a, b) for a in names for b in names if a < b and owner[a] & owner[b]}
    recall, precision = scored(found, true)
    assert recall > 0.97 and precision > 0.97, (recall, precision, sorted(true - found)[:8], sorted(found - true)[:8])
