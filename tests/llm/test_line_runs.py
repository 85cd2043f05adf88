"""Line dedup against brute force."""

import pytest
from pyspark.sql import functions as F

from cardwatch.llm import line_runs

LINE = "This very line is shared by many documents"
WHITE = " \t\n\x0b\x0c\r"


def key_of(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(WHITE))


def brute(rows, min_docs=3, min_chars=20):
    holders = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key_of(line)) >= min_chars:
                holders.setdefault(key_of(line), set()).add(doc_id)
    shared = {k: max((d for d in ids if d is not None), default=None) for k, ids in holders.items() if len(ids) >= min_docs}
    result = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key_of(x) not in shared or shared[key_of(x)] == doc_id]
        result.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(result, key=repr)


def found(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def test_largest_id_keeps_the_line(frame):
    rows = [(d, f"Head {d}\n{LINE}\n own line number {d} of this text\n{LINE.upper()}  ") for d in range(10)]
    assert found(line_runs.drop_lines(frame(rows))) == brute(rows)


def test_two_documents_are_not_enough(frame):
    rows = [(1, LINE), (2, LINE), (3, "short"), (4, "short"), (5, "short")]
    got = found(line_runs.drop_lines(frame(rows)))
    assert got == brute(rows) and sum(r[2] for r in got) == 0


def test_white_space_letters_and_length(frame):
    twenty = "é" * 19 + "x"
    rows = [(d, f"\t {twenty}\r\n{twenty[1:]}\n{LINE}\x0b\x0c\n {LINE}\n") for d in range(4)]
    assert found(line_runs.drop_lines(frame(rows))) == brute(rows)


def test_nulls_empty_repeated_rows_and_clashing_ids(frame):
    rows = [
        (None, None), (None, LINE), (None, f"{LINE}\nx"), (1, ""), (1, LINE), (1, LINE), (1, f"a\n{LINE}"), (2, f"{LINE}\n{LINE}"),
        (3, "\n\n"), (4, None),
    ]
    assert found(line_runs.drop_lines(frame(rows))) == brute(rows)


def test_lines_of_rows_without_id_only(frame):
    rows = [(None, LINE)] * 5
    assert found(line_runs.drop_lines(frame(rows))) == brute(rows)


def test_very_long_text(frame):
    long = "\n".join(f"line {n} of a very long document text" for n in range(20_000))
    rows = [(1, long), (2, long), (3, long + "\nmore"), (4, "none")]
    assert found(line_runs.drop_lines(frame(rows))) == brute(rows)


@pytest.mark.parametrize("batches,fan_out", [(1, 2), (3, 2), (7, 3), (8, 2)])
def test_rows_do_not_depend_on_batches_and_levels(frame, batches, fan_out):
    rows = [(d, "\n".join(f"Common line of the group number {d % g} of {g}" for g in (2, 3, 7, 19, 50))) for d in range(60)]
    assert found(line_runs.drop_lines(frame(rows), batches=batches, fan_out=fan_out)) == brute(rows)


def test_runs_hold_a_line_once_and_are_compacted(lm, frame):
    store = line_runs.LineRuns(lm, fan_out=2)
    for b in range(5):
        places = line_runs.line_places(frame([(b * 10 + k, f"{LINE}\nline {b} of batch, number {k} in it") for k in range(3)]))
        store.add(places)
    assert [len(level) for level in store.levels] == [1, 0, 1]
    new = [r for run in store.runs() for r in run.where(~F.col("seen")).collect()]
    assert len({(r.h1, r.h2) for r in new}) == len(new) == 16
    shared = store.shared_lines().collect()
    assert [r.top_doc for r in shared] == [42]
    store.close()


def test_a_batch_meets_the_runs_without_shuffling_them(lm, frame, conf):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    store = line_runs.LineRuns(lm, fan_out=9)
    places = line_runs.line_places(frame([(k, f"{LINE}\nline number {k} of this document") for k in range(20)]))
    store.add(places)
    counts = places.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("top_doc"))
    plan = store.marked(counts)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    store.close()


def test_empty_table_and_further_columns(lm, frame):
    assert line_runs.drop_lines(frame([])).count() == 0
    rows = [(d, LINE) for d in range(4)]
    wide = lm.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, h1 int, lines string, batch int")
    assert found(line_runs.drop_lines(wide)) == brute(rows)
