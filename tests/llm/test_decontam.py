"""Decontamination: the broadcast and the shuffle form give the same rows, and runs are the longest ones."""

import random
from collections import Counter

from muster.llm import decontam

ITEM = "If Ann drives 12 miles in 30 minutes and then rests at home for 10 minutes how far did Ann go today."
OTHER = "a plain question on rivers and lakes that nobody has asked here before in this form at all"


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_both_forms_are_equal_multisets(spark, tmp_path, monkeypatch):
    again = ITEM.replace("Ann", "Bob").replace("12", "40")
    docs = [
        (1, "before words. " + ITEM), (1, "before words. " + ITEM), (1, again + " after it " + OTHER), (2, ITEM + "\n" + again), (3, OTHER),
        (4, "nothing of the kind at all"), (5, None), (None, again), (None, again), (6, ""), (7, ITEM.replace(" 30 ", "\u00a030\u00a0")),
    ]
    bench = [(5, ITEM), (5, ITEM), (5, OTHER), (6, OTHER.replace(" on ", "\u00a0on ")), (7, None), (8, "too short")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    small = decontam.op6_decontam(spark, str(tmp_path))
    want = rows(small)
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", 0)
    large = decontam.op6_decontam(spark, str(tmp_path))
    assert large.columns == small.columns == ["doc_id", "item_id", "item_words", "matched", "coverage", "first_word", "exact"]
    assert large.dtypes == small.dtypes
    assert rows(large) == want
    assert sum(n for r, n in want.items() if r[:2] == (1, 5)) == 7 and sum(n for r, n in want.items() if r[0] is None) == 4


def test_the_filter_keeps_every_benchmark_window(spark):
    bench = spark.createDataFrame([(1, ITEM), (2, OTHER)], "id long, text string")
    table = decontam.window_table(bench, "item")
    kept = decontam.window_table(bench, "item", decontam.window_filter(table))
    assert rows(kept.select("item_id", "at", "v")) == rows(table.select("item_id", "at", "v"))


def brute_run(starts, item, doc, offset):
    """All runs of all covered places; a place beside a window is covered if all between agree and it is near enough."""
    width = decontam.WINDOW
    same = lambda t: (t + offset) in doc and (item[t][1] == doc[t + offset][1] or (item[t][0] > 0 and {3: 3, 4: 3}.get(item[t][0], item[t][0]) == {3: 3, 4: 3}.get(doc[t + offset][0], doc[t + offset][0])))
    covered = {
        t for t in item for s in starts
        if s <= t < s + width or (0 < s - t <= width and all(same(u) for u in range(t, s))) or (0 <= t - s - width < width and all(same(u) for u in range(s + width, t + 1)))
    }
    best = (0, 0)
    for i in sorted(covered):
        seen = {}
        for t in range(i, max(covered) + 1):
            value = (min(item[t][0], 3), item[t][1]) if t in covered else None
            if value is None or value[0] and seen.setdefault(value, doc[t + offset][1]) != doc[t + offset][1]:
                break
            best = max(best, (t - i + 1, -i))
    return -best[1], best[0]


def test_a_contradicted_slot_does_not_hide_the_longest_run():
    words = "we think that Ann walked down to see whether all Ann could still find old boats upon this very lake".split()
    item, doc = " ".join(words), " ".join([*words[:3], "Zoe", *words[4:]])
    index = decontam.Index([(1, item)])
    (_, size, matched, _, first, exact), = decontam.leaks(doc, index, decontam.Lexer())
    assert (matched, first, exact) == (size - 4, 4, True)


def test_runs_are_those_of_a_brute_force():
    rnd = random.Random(3)
    for _ in range(500):
        n = rnd.randrange(decontam.WINDOW, 40)
        item = {t: (rnd.choice((0, 0, 1, 2, 3, 4)), rnd.choice("ab")) for t in range(n)}
        doc = {t + 5: (item[t][0] if rnd.random() < 0.8 else 0, rnd.choice("aab")) for t in range(n)}
        starts = {s for s in range(n - decontam.WINDOW + 1) if rnd.random() < 0.2} or {0}
        assert decontam.matched_run(starts, decontam.WINDOW, item, doc, 5) == brute_run(starts, item, doc, 5)


NAMES, UNITS = ("Tom", "Sam", "Ada", "Ines", "Otto"), ("km", "miles", "kg", "minutes")
FORMS = (
    "{n0} has {v0} apples and buys {v1} more apples today.",
    "{n0} walks {v0} {u0} to school and {n1} walks {v1} {u0} home. How far do {n0} and {n1} walk in all?",
    "A train with {v0} coaches left the old town. {n0} counted {v1} seats in every coach of it. How many seats were there?",
    "It took {n0} {v0} minutes to paint the long wall, and {n1} {v1} minutes. Who of them was faster and by how much?",
)


def filled(rnd, form, words):
    """A form with values; numbers in digits, in words, or glued to a unit."""
    def number(k):
        n = rnd.randrange(21, 99)
        tens, ones = divmod(n, 10)
        text = ("twenty thirty forty fifty sixty seventy eighty ninety".split()[tens - 2] + " " + " one two three four five six seven eight nine".split(" ")[ones]).strip()
        return text if words and tens < 6 and rnd.random() < 0.4 else str(n)

    slots = {f"n{i}": n for i, n in enumerate(rnd.sample(NAMES, 2))} | {"v0": number(0), "v1": number(1), "u0": rnd.choice(UNITS)}
    text = form.format(**slots)
    if words and rnd.random() < 0.5:
        for u in UNITS:
            text = text.replace(f"9 {u}", f"9{u}").replace(f"5 {u}", f"5{u}").replace(f"2 {u}", f"2{u}")
    return text


def test_refilled_questions_are_found(spark, tmp_path, monkeypatch):
    """The forms say which text refills which item, so no part of the operator decides what has to be found."""
    rnd = random.Random(11)
    bench = [(k, filled(rnd, f, False)) for k, f in enumerate(FORMS)]
    clean = "the {0} river runs past the mill where nobody has asked for {1} apples or any train and the old wall is long".format
    docs, want = [], set()
    for k in range(200):
        form = rnd.randrange(len(FORMS))
        before = rnd.choice(["", "Question: ", "we read that ", "Some text before. "])
        docs.append((k, before + filled(rnd, FORMS[form], True) + rnd.choice(["", " And more of it."])))
        want.add((k, form))
    docs += [(1000 + k, clean(rnd.choice(NAMES), rnd.randrange(9))) for k in range(50)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    small = rows(decontam.op6_decontam(spark, str(tmp_path)))
    got = {(r[0], r[1]) for r in small}
    assert len(got & want) >= 0.9 * len(want), sorted(want - got)[:5]
    assert not got - want
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", 0)
    assert rows(decontam.op6_decontam(spark, str(tmp_path))) == small


def test_tokens_of_numbers_and_units():
    lexer = decontam.Lexer()
    own, kind, ids = lexer.tokens("Tom ran 60km over twenty five minutes, and three hundred more. Two boats")
    assert [(int(k), lexer.core[i]) for k, i in zip(kind, ids)] == [
        (4, "tom"), (0, "ran"), (1, "60"), (2, "km"), (0, "over"), (1, "twenty five"), (2, "minutes"), (0, "and"), (1, "three hundred"), (0, "more"), (1, "two"), (0, "boats"),
    ]


def test_an_item_below_the_window_matches_whole(spark, tmp_path, monkeypatch):
    short, filled = "what does the red boat carry home", "pack 12 eggs in each box"
    docs = [
        (1, "so: " + short + "?"), (2, "what does the red boat carry away"), (3, "now pack 30 eggs in each box please"), (4, "pack some eggs in each box"),
        (5, OTHER), (6, short), (7, "red boat"), (8, None), (9, ""),
    ]
    bench = [(1, short), (2, filled), (3, "red boat"), (4, "12 30 mm 7 Ann"), (5, OTHER), (6, ""), (7, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    small = decontam.op6_decontam(spark, str(tmp_path)).collect()
    got = {(r["doc_id"], r["item_id"], r["matched"], r["first_word"], r["exact"]) for r in small}
    size = len(OTHER.split())
    assert got == {(1, 1, 7, 1, True), (6, 1, 7, 0, True), (3, 2, 6, 1, False), (5, 5, size, 0, True), (7, 3, 2, 0, True)}
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", 0)
    assert rows(decontam.op6_decontam(spark, str(tmp_path))) == Counter(map(tuple, small))


def test_an_item_of_few_literals_matches_verbatim(spark, tmp_path, monkeypatch):
    """By a plain comparison of word lists: numbers are the values themselves, and a tiny item must be the whole text."""
    sums, code, tiny = "12 plus 30 minus 7 times 9 15", "3 1 4 1 5 9 2 6 5 3 5 8 9 7 9", "forty"
    docs = [
        (1, "we know that " + sums + " or so"), (2, "we know that 12 plus 31 minus 7 times 9 15"), (3, "digits " + code), (4, code[:-2] + " 8"), (5, code[:13]),
        (6, "Forty!"), (7, "she is forty now"), (8, ""), (9, None), (10, "1 2 1 2 1 2 1 2 1 2"),
    ]
    bench = [(1, sums), (2, code), (3, tiny), (4, "1 2 1 2 1 2"), (5, ""), (6, "?!"), (7, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    words = lambda t: [w for w in (x.strip("!?").lower() for x in (t or "").split()) if w]

    def longest(a, b):
        return max((k for i in range(len(a)) for j in range(len(b)) for k in range(1, len(a) - i + 1) if a[i : i + k] == b[j : j + k]), default=0)

    want = set()
    for d, text in docs:
        for i, item in bench:
            a, b = words(item), words(text)
            n = longest(a, b)
            if a and n >= min(decontam.RUN, len(a)) and (len(a) >= 4 or a == b):
                want.add((d, i, n, True))
    small = decontam.op6_decontam(spark, str(tmp_path)).collect()
    assert {(r["doc_id"], r["item_id"], r["matched"], r["exact"]) for r in small} == want
    assert want == {(1, 1, 8, True), (3, 2, 15, True), (4, 2, 14, True), (6, 3, 1, True), (10, 4, 6, True)}
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", 0)
    assert rows(decontam.op6_decontam(spark, str(tmp_path))) == Counter(map(tuple, small))
