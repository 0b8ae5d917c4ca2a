"""U2 with a ledger: no answered prompt is asked again, also when a task dies half-way."""
import os
import tempfile

import pytest

from retrieva.operators import answer as AN


def counting(folder, deadly=None):
    """A generator that notes each call in a file of a shared folder, and kills its Python worker at the first call of one prompt. (A closure, which
    travels to the workers by value.)"""
    def generator(prompt):
        import os
        with open(os.path.join(folder, "calls"), "a") as f:
            f.write(prompt + "\n")
        if prompt == deadly and not os.path.exists(os.path.join(folder, "died")):
            open(os.path.join(folder, "died"), "w").close()
            os._exit(1)
        if "bad" in prompt:
            raise RuntimeError("no answer")
        return "answer to " + prompt
    return generator


def calls(folder):
    with open(os.path.join(folder, "calls")) as f:
        return f.read().splitlines()


def prompts(spark, names):
    return spark.createDataFrame([(i, p) for i, p in enumerate(names)], "id long, prompt string")


def test_later_runs_ask_only_what_is_open(spark):
    d, ledger = tempfile.mkdtemp(), tempfile.mkdtemp()
    g = counting(d)
    first = AN.generate_once(prompts(spark, ["a", "b", "a", "bad", None]), ledger, g, retry_wait=0.0)
    rows = sorted((r.id, r.answer, r.attempts, r.error) for r in first.collect())
    assert rows == [(0, "answer to a", 1, False), (1, "answer to b", 1, False), (2, "answer to a", 1, False), (3, "[ERROR]", 2, True), (4, "answer to ", 1, False)]
    assert first.count() == 5 and sorted(calls(d)) == ["", "a", "b", "bad", "bad"]  # reading the result twice asks nothing
    AN.generate_once(prompts(spark, ["b", "c", "bad"]), ledger, g, retry_wait=0.0, ask_failures_again=False).count()
    assert sorted(calls(d)) == ["", "a", "b", "bad", "bad", "c"]
    again = AN.generate_once(prompts(spark, ["bad", "c"]), ledger, counting(tempfile.mkdtemp()), retries=0, failure="none")
    assert sorted((r.answer, r.error) for r in again.collect()) == [("[ERROR]", True), ("answer to c", False)]
    assert AN.generate_once(prompts(spark, ["x"]).limit(0), ledger, g).count() == 0


@pytest.mark.skipif("local-cluster" in os.environ.get("MASTER", ""), reason="needs a session of its own")
def test_a_task_killed_half_way_asks_nothing_twice(spark):
    """The worker dies at the 7th of 12 prompts of its task. Spark runs the task again: the six answered ones aren't asked a second time."""
    d, ledger = tempfile.mkdtemp(), tempfile.mkdtemp()
    names = [f"p{i:02d}" for i in range(12)]
    keys = {r.prompt: r.k for r in prompts(spark, names).select("prompt", AN.prompt_key("prompt").alias("k")).collect()}
    order = sorted(names, key=keys.get)
    g = counting(d, deadly=order[6])
    job = prompts(spark, names)
    failures = spark.sparkContext.getConf().get("spark.task.maxFailures", None)
    with pytest.raises(Exception):  # noqa: B017 - one process allows a task one failure: the job ends, as if the driver had been lost
        AN.generate_once(job, ledger, g, partitions=1).count()
    assert calls(d) == order[:7] and failures is None
    # the job is started again: only the prompt that was under way, and those after it
    out = AN.generate_once(job, ledger, g, partitions=1)
    assert sorted(r.answer for r in out.collect()) == sorted("answer to " + p for p in names)
    assert calls(d) == order[:7] + order[6:]


def test_a_second_attempt_of_a_task_reads_its_share(spark, tmp_path):
    """What an attempt has written is known to the next attempt of the same run, before the job is over."""
    from retrieva.session import shared_fs
    fs, root = shared_fs(str(tmp_path))
    os.makedirs(tmp_path / "run=1" / "share=0")
    (tmp_path / "run=1" / "share=0" / "x.jsonl").write_text('{"key": "k1", "answer": "a"}\n{"key": "k2", "answer": "b"}\n')
    (tmp_path / "run=1" / "share=0" / "y.part").write_text('{"key": "k3"')
    assert AN._keys_in(fs, f"{root}/run=1/share=0") == {"k1", "k2"} and AN._keys_in(fs, f"{root}/run=1/share=9") == set()
    rows = AN.read_ledger(spark, str(tmp_path)).select("key").collect()
    assert sorted(r.key for r in rows) == ["k1", "k2"]
