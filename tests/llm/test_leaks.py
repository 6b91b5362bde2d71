"""Leaks that one template, sparse windows or a check of all slots would lose."""

from tessera.llm import decontaminate

ITEM = "If Anna buys 12 apples and 3 pears for 5 dollars each, how many euros does Anna have left today?"


def leaks(spark, docs, items, **how):
    frames = [spark.createDataFrame(list(enumerate(x)), f"{c} long, text string") for c, x in (("doc_id", docs), ("item_id", items))]
    return {(r.doc_id, r.item_id): r.kind for r in decontaminate.find_leaks(*frames, **{"folded": True} | how).collect()}


def test_any_case_of_letters(spark):
    docs = [f"before {ITEM.upper()} AFTER", ITEM.lower(), ITEM.upper().replace("12", "x"), "NOTHING OF IT AT ALL BUT NINE WORDS", ITEM.replace("Anna", "Maria").upper(), ITEM.replace("Anna", "Maria").replace("12", "40")]
    assert leaks(spark, docs, [ITEM]) == {(0, 0): "verbatim", (1, 0): "verbatim", (2, 0): "verbatim", (4, 0): "verbatim", (5, 0): "reparameterised"}


def test_short_items_at_every_offset(spark):
    items = ["pure reason", "why is it so", *(" ".join(f"w{chr(97 + k)}{chr(97 + i)}" for i in range(n)) for k, n in enumerate(range(1, 13))), "Paris", ""]
    docs = [" ".join(["x"] * before + [t] + ["y"] * 9) for t in items[:-1] for before in range(9)]
    found = leaks(spark, [*docs, "London"], items)
    assert found == {(d, d // 9): "verbatim" for d in range(len(docs))}


def test_coverage_holds_whatever_words_are_changed(spark):
    """All pairs that reach the coverage, by brute force, with changes dealt out to leave the shortest runs."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    items, docs, expected = [], [], set()
    for k, n in enumerate([*range(2, 26), 40, 50]):
        words = [f"q{letters[k]}{letters[i % 26]}{letters[i // 26]}" for i in range(n)]
        for m in range(1, n // 5 + 2):
            gone = {round((j + 1) * (n + 1) / (m + 1)) - 1 for j in range(m)}
            docs.append(" ".join(["pre"] * (m % 4) + ["zz" if i in gone else w for i, w in enumerate(words)] + ["post"]))
            if (n - len(gone)) / n >= decontaminate.COVERAGE or max(map(len, "".join("0" if i in gone else "1" for i in range(n)).split("0"))) >= decontaminate.RUN:
                expected.add((len(docs) - 1, k))
        items.append(" ".join(words))
    assert set(leaks(spark, docs, items)) == expected


def test_chance_slots_beyond_a_copied_passage(spark):
    passage = "Now Anna takes 7 of those old red carts over some bridge toward town 4 times"
    item = f"{passage} before Anna goes away and rests or reads or writes about 7 birds and more things than one ever saw"
    # In line by chance: a name and a number that contradict the passage, and a number right behind another one.
    tail = lambda name, n: f"xx {name} xx xx xx xx xx xx xx xx xx {n} xx xx xx"
    docs = [f"{passage} {tail('Berta', 9)}", f"{passage.replace('Anna', 'Maria').replace('7', '8')} {tail('Berta', 9)}", f"only Anna takes 7 of {tail('Berta', 9)}", passage.replace("7", "8").replace(" 4", " 7") + " zz"]
    assert leaks(spark, docs, [item]) == {(0, 0): "verbatim", (1, 0): "reparameterised", (3, 0): "reparameterised"}
    runs = "7 takes of those old red carts over some bridge toward town in all 7 and then many other things come to pass in here"
    docs = ["9 takes of those old red carts over some bridge toward town in all 7 zz", "takes of those old red carts over some bridge toward town zz"]
    assert set(leaks(spark, docs, [runs])) == {(0, 0)}


def test_names_must_stay_apart(spark):
    item = "When Anna met Berta they gave 7 coins to Clara and 9 to all of their friends in town"
    docs = [item.replace("Anna", "Xenia").replace("Berta", "Yara"), item.replace("Anna", "Xenia").replace("Berta", "Xenia"), item.replace("7", "8").replace("9", "8")]
    assert leaks(spark, docs, [item], folded=False) == {(0, 0): "reparameterised", (2, 0): "reparameterised"}
