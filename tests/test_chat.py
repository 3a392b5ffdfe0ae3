from marginalia.operators import chat as ch


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_notes_by_title_behind_the_pinned_one(spark):
    matches = frame(spark, [(1, 1, "A", ["x", "y"]), (1, 2, "Day", ["no"]), (1, 3, "B", ["z"]), (1, 4, "A", ["w"]), (2, 1, "Day", ["secret"]), (2, 2, "B", []), (3, 1, "C", ["c"])], "k int, rank int, title string, excerpts array<string>")
    pinned = frame(spark, [(1, "Day", " ", False), (2, "Day", "secret", True), (4, "D", "only", None)], "k int, title string, content string, locked boolean")
    made = {r.k: (r.body, r.titles) for r in ch.section(ch.note_entries(matches, pinned, "k"), "notes", "k").collect()}
    assert made == {
        1: ('USER NOTES:\n[Note: "Day"]\n(empty note)\n\n[Note: "A"]\nx\ny\nw\n\n[Note: "B"]\nz', ["Day", "A", "B"]),
        2: ('USER NOTES:\n[Note: "B"]\n', ["B"]),
        3: ('USER NOTES:\n[Note: "C"]\nc', ["C"]),
        4: ('USER NOTES:\n[Note: "D"]\nonly', ["D"]),
    }


def test_sections_in_order_and_messages(spark):
    turns = frame(spark, [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", "who")], "k int, turn int, role string, text string")
    files = ch.section(ch.found_entries(frame(spark, [(1, 1, "f", "/f.txt", ["p", "q"])], "k int, rank int, title string, path string, excerpts array<string>"), "k"), "files", "k")
    wiki = ch.section(ch.found_entries(frame(spark, [(1, 2, "W", ["w"]), (1, 1, "V", ["v"])], "k int, rank int, title string, excerpts array<string>"), "k"), "articles", "k")
    opened = ch.open_note(frame(spark, [(1, " T ", None)], "k int, title string, content string"), "k")
    made = ch.assembled(turns, "k", opened=opened, articles=wiki, files=files)
    got = {r.k: r for r in made.collect()}
    assert got[1].context == '## Note the user currently has open\n### T\n\n\nWIKIPEDIA ARTICLES:\n[Wikipedia: "V"]\nv\n\n[Wikipedia: "W"]\nw\n\nSCANNED FILES:\n[File: "f" (/f.txt)]\np\nq'
    assert got[1].sources == ["articles", "files"] and got[1].article_titles == ["V", "W"] and got[1].note_titles == []
    assert got[2].context is None and got[2].sources == []
    said = [(r.k, r.turn, r.role) for r in ch.messages(turns, made, "k").orderBy("k", "turn").collect()]
    assert said == [(1, -1, "system"), (1, 0, "user"), (1, 1, "assistant"), (2, 0, "user")]
    days = frame(spark, [(1, "2024-01-02")], "k int, day_title string")
    asked = frame(spark, [(1, "what"), (2, "who"), (3, None)], "k int, query string")
    assert {r.k: r.query for r in ch.note_queries(asked, days, "k").collect()} == {1: "what 2024-01-02", 2: "who", 3: None}


def brute_board(label, notes, values, options, rows):
    """One folder's board, by loops; ``values`` of the choice by note."""
    columns = {x: [] for x in [*options, ""]}
    for note in sorted(notes):
        columns.setdefault((values.get(note) or "").strip(), []).append(note)
    lines, total = [f"## {label}", "Property definitions:", f"- state (select) — options: {', '.join(options)}", "- n (number)"], 0
    for value, held in columns.items():
        if total >= rows:
            break
        shown = held[: rows - total]
        lines.append(f"\n### {value or 'Unset'} ({len(held)})")
        for note in shown:
            cells = ([f"state: {values[note]}"] if (values.get(note) or "").strip() else []) + ([f"n: {note}"] if note % 3 == 0 else [])
            lines.append(f"- t{note}" + (f" [{', '.join(cells)}]" if cells else ""))
        total += len(shown)
    if len(notes) > total:
        lines.append(f"\n... and {len(notes) - total} more cards not shown")
    return "\n".join(lines)


def test_views_show_their_first_rows(spark):
    options = ["open", "done", "never"]
    of = lambda note: [None, "open", "done", " ", "other", "b"][note % 6 if note < 100 else 1]
    folder = {n: 0 if n < 40 else 1 if n < 100 else 2 for n in range(170)}
    folders = frame(spark, [(i, f"F{i}") for i in range(4)], "folder_id int, label string")
    notes = frame(spark, [(f, n, f"t{n}") for n, f in folder.items()], "folder_id int, note_id int, title string")
    defs = frame(spark, [x for f in range(4) for x in ((f, 10 * f, "state", "select", options, 0), (f, 10 * f + 1, "n", "number", None, 1))], "folder_id int, def_id int, name string, type string, options array<string>, position int")
    cells = frame(spark, [x for n, f in folder.items() for x in ([(n, 10 * f, of(n))] if of(n) is not None else []) + ([(n, 10 * f + 1, str(n))] if n % 3 == 0 else [])], "note_id int, def_id int, value string")
    for rows in (50, 7):
        got = {r.folder_id: r.body for r in ch.board_view(folders, notes, cells, defs, rows).collect()}
        for i in range(4):
            mine = [n for n, f in folder.items() if f == i]
            assert got[i] == brute_board(f"F{i}", mine, {n: of(n) for n in mine}, options, rows)
    table = {r.folder_id: r.body.split("\n") for r in ch.table_view(folders, notes, cells, defs, 5).collect()}
    assert table[0] == ["## F0", "Property definitions:", "- state (select) — options: open, done, never", "- n (number)", "- **t0** — n: 0", "- **t1** — state: open", "- **t2** — state: done", "- **t3** — n: 3", "- **t4** — state: other", "", "... and 35 more rows not shown"]
    assert table[3] == table[0][:0] + ["## F3", *table[0][1:4]]
