"""A section's successor: each branch by hand."""

from quillon.operators import transitions as tr


def test_learned_word_before_the_table(spark):
    sections = spark.createDataFrame([(1, "Indian Penal Code 1860", "302"), (2, "IPC", "Section 303"), (3, "Indian Penal Code 1860", "304"), (4, "Indian Penal Code 1860", "305"), (5, "Code of Criminal Procedure 1973", "41"), (6, "Cr.P.C 1973", "42"), (7, "Companies Act 2013", "302"), (8, None, "302"), (9, "IPC", None), (10, "Indian Penal Code 1860", "999"), (11, "Indian Penal Code 1860", "306")], "id int, act_name string, section_number string")
    predicted = spark.createDataFrame([("Indian Penal Code 1860", "302", True, "BNS Section 103"), ("Indian Penal Code 1860", "304", False, "never"), ("Indian Penal Code 1860", "306", True, ""), ("Code of Criminal Procedure 1973", "41", True, None), ("Companies Act 2013", "302", True, "other acts aren't asked"), (None, "302", True, "x")], "act_name string, section_number string, is_superseded boolean, replacement string")
    table = spark.createDataFrame([("IPC", "302", "101", "the table doesn't win"), ("IPC", "303", "104", "renumbered"), ("IPC", "304", "105", "widened"), ("IPC", "305", "removed", "gone"), ("CrPC", "42", "39", "same")], "old string, section string, new string, changes string")
    got = {r.id: r for r in tr.transitions(sections, predicted, table).collect()}
    assert len(got) == 11
    assert {i: (r.replaced_by, r.source) for i, r in got.items()} == {
        1: ("BNS Section 103", "learned"), 2: ("BNS Section 104", "rule_map"), 3: ("BNS Section 105", "rule_map"), 4: ("Removed in BNS", "rule_map"),
        5: ("BNSS equivalent", "learned"), 6: ("BNSS Section 39", "rule_map"), 7: (None, None), 8: (None, None), 9: (None, None), 10: (None, None), 11: ("Removed in BNS", "learned"),
    }
    assert got[1].changes == "learned transition classifier" and got[1].note == "⚠️ Note: IPC Section 302 has been superseded. Suggested replacement: BNS Section 103."
    assert got[2].original == "IPC Section 303" and got[2].note == "⚠️ Note: IPC Section 303 has been replaced by BNS Section 104. Changes: renumbered"
    assert got[4].note == "⚠️ Note: IPC Section 305 has been removed in Bharatiya Nyaya Sanhita 2023."


def test_nearest_positive(spark):
    known = spark.createDataFrame([("a", [1.0, 0.0], 1), ("b", [0.0, 1.0], 1), ("c", [0.7, 0.7], 0)], "name string, v array<double>, label int")
    asked = spark.createDataFrame([(1, [0.9, 0.1]), (2, [0.5, 0.6])], "id long, v array<double>")
    assert {(r.id, r.replacement) for r in tr.nearest_positive(asked, known, key="id", vector="v", name="name").collect()} == {(1, "a"), (2, "b")}
