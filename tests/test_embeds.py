from marginalia.operators import embeds


def test_contents_are_looked_up_once_and_not_written_again(spark, monkeypatch):
    written, inner = [], embeds.persisted
    monkeypatch.setattr(embeds, "persisted", lambda df, name: written.append(inner(df, name)) or written[-1])
    rows = [(i, f"t{i}", f"{i} ![[t{(i + 1) % 4 if i < 4 else i % 3}]] ![[gone]] end", i % 2) for i in range(40)]
    notes = spark.createDataFrame(rows, "note_id long, title string, content string, folder_id long").withColumn("updated_at", embeds.F.lit(0))
    shut = spark.createDataFrame([(9,)], "folder_id long")
    got = {r.note_id: (r.text, r.faults) for r in embeds.expanded(notes, shut).collect()}
    held = [df for df in written if "content" in df.columns]
    assert len(held) == 1 and held[0].count() == 4  # the notes that others embed, whatever the levels

    def text(i, trail):
        to = (i + 1) % 4 if i < 4 else i % 3
        inside, faults = ("[circular: t%d]" % to, 1) if to in trail else text(to, [*trail, to])
        return f"{i} {inside} [missing: gone] end", faults + 1

    assert got == {i: text(i, [i]) for i in range(40)}
