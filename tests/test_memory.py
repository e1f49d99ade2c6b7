"""How much the Python workers of an executor grow, where a batch is large."""

import os
import threading

from pyspark.sql import functions as F

from glossa.operators import segment as sg
from glossa.operators import subword as sw
from glossa.sources.store import table


def memory() -> dict[str, float]:
    """MB of each Python process below the driver's, by id."""
    found, parents = {}, {}
    for pid in filter(str.isdigit, os.listdir("/proc")):
        try:
            with open(f"/proc/{pid}/stat") as f:
                name, rest = f.read().split("(", 1)[1].rsplit(")", 1)
            with open(f"/proc/{pid}/statm") as f:
                found[pid] = (name, int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 1e6)
        except OSError:
            continue
        parents[pid] = rest.split()[1]

    def below(pid):
        while pid in parents:
            pid = parents[pid]
            if pid == str(os.getpid()):
                return True
        return False

    return {pid: mb for pid, (name, mb) in found.items() if "python" in name and below(pid)}


def growth(action) -> float:
    """MB that the one worker which grows most has at its peak above its start; a worker that the action starts counts from 100."""
    first, most, done = memory(), [0.0], threading.Event()

    def watch():
        while not done.wait(0.02):
            most[0] = max([most[0], *(mb - first.get(pid, 100) for pid, mb in memory().items())])

    thread = threading.Thread(target=watch)
    thread.start()
    try:
        action()
    finally:
        done.set()
        thread.join()
    return most[0]


def test_scoring_holds_a_slice_of_a_batch_as_texts(spark):
    """A batch of 60 MB, whose texts need 4 bytes a code point in Python, comes in; its buffers are there, perhaps twice, but not its texts."""
    model = spark.createDataFrame([(y, t, w, 1) for y, a in (("p", -1.0), ("q", -2.0)) for t, w in (("a", a), ("b", -1.5))], "y string, token string, w double, n_lines long")
    lines = spark.range(0, 4000, 1, 1).select(F.col("id").alias("line_idx"), F.concat(F.lit("😀"), F.repeat(F.lit("ab a"), 3750), F.col("id").cast("string")).alias("text"))
    rows = []
    assert growth(lambda: rows.extend(sg.score_lines(lines, model, 1).groupBy(F.col("cands")[0]["label"].alias("label"), "status").count().collect())) < 250
    assert [tuple(r) for r in rows] == [("p", "SCORED", 4000)]


def test_substrings_of_long_words_take_a_slice_at_a_time(spark):
    """1,500 words of 4,000 code points fit into one batch; each code point takes about 100 bytes while it is walked."""
    words = table(spark.range(0, 1500, 1, 1).select(F.concat(F.repeat(F.lit("abcd"), 1000), F.col("id").cast("string")).alias("word"), F.lit(2).cast("long").alias("n")), "long")
    found = {}
    assert growth(lambda: found.update((r["token"], r["n"]) for r in sw.substring_counts(words.coalesce(1), 1_000_000, 3).collect())) < 250
    often = {t: 3000 * 1000 for t in ("a", "b", "c", "d", "ab", "bc", "cd", "abc", "bcd")}
    assert found == often | {t: 3000 * 999 for t in ("da", "cda", "dab")}
