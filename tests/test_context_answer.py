from retrieva.operators import answer as AN
from retrieva.operators import context as CX


def test_packing_rules(spark):
    rows = [(1, 1, "x" * 3000), (1, 2, "small"),               # first over the limit: empty context
            (2, 1, "a" * 10), (2, 2, "b" * 2977),               # 0+10 < 3000; 12 + 2977 = 2989 < 3000
            (3, 1, "c" * 2998), (3, 2, "d" * 5), (3, 3, "e")]  # 2998 fits; 3000 + 5 does not; 'e' stays out
    df = spark.createDataFrame(rows, "query_id long, rank long, text string")
    got = {r.query_id: r for r in CX.pack_context(df, "text", "rank", 3000).collect()}
    assert got[1].context == "" and got[1].n_docs == 0
    assert got[2].n_docs == 2
    assert got[3].n_docs == 1 and got[3].context == "c" * 2998 + "\n\n"
    exact = spark.createDataFrame([(4, 1, "z" * 2999)], "query_id long, rank long, text string")
    assert CX.pack_context(exact, "text", "rank", 3000).first().n_docs == 1   # limit - 1 fits
    for r in got.values():
        assert len(r.context) <= 3000 + 2


def test_generator_retry(spark):
    df = spark.createDataFrame([(1, "once"), (2, "twice"), (3, "never")], "id long, prompt string")

    def gen(p):
        if p == "never":
            return "fine"
        raise RuntimeError("down")

    out = {r.id: r for r in AN.generate(df, gen, keep=["id"], retry_wait=0.0).collect()}
    assert out[3].answer == "fine" and out[3].attempts == 1 and not out[3].error
    assert out[1].answer == "[ERROR]" and out[1].attempts == 2 and out[1].error

    calls = {}

    def once(p):
        calls[p] = calls.get(p, 0) + 1
        if calls[p] == 1:
            raise RuntimeError("first call fails")
        return "second:" + p

    out = {r.id: r for r in AN.generate(df, once, keep=["id"], retry_wait=0.0, partitions=1).collect()}
    assert all(r.attempts == 2 and not r.error and r.answer.startswith("second:") for r in out.values())
    variant2 = AN.generate(df, gen, keep=["id"], retries=0, failure="", retry_wait=0.0).collect()
    assert sorted(r.answer for r in variant2) == ["", "", "fine"]


def test_the_stub_keeps_every_passage_whole():
    body = "\n\nTitle:\n" + "line one\n" + "x" * 2000 + "\n\nSecond:\nmore"
    assert AN.extractive_generator(f"Use it.\n\nContext:\n{body}\n\nQuestion:\nwhy?\n") == " " + body.strip("\n")


def test_every_question_gets_an_answer(spark):
    from retrieva.plans import catalog
    q = spark.createDataFrame([(1, "a"), (2, "b")], "query_id long, question string")
    c = spark.createDataFrame([(1, "found")], "query_id long, context string")
    assert {r.query_id: r.context for r in catalog._asked(q, c).collect()} == {1: "found", 2: ""}


def test_model_embeddings_run_a_given_encoder(spark):
    df = spark.createDataFrame([(i, "x" * i) for i in range(70)] + [(100, None)], "doc_id long, text string")
    got = {r.doc_id: r.embedding for r in AN.model_embeddings(df, "doc_id", "text", lambda ts: [[len(t), 1.0] for t in ts]).collect()}
    assert got[5] == [5.0, 1.0] and got[100] == [0.0, 1.0] and len(got) == 71


def test_rate_limited_prompts_are_dealt_over_tasks(spark):
    df = spark.createDataFrame([(i, "p") for i in range(8)], "id long, prompt string").coalesce(1)
    out = AN.generate(df, lambda p: "a", keep=["id"], max_requests_per_minute=60000)
    assert out.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and out.count() == 8


def test_prompt_and_request(spark):
    import json
    df = spark.createDataFrame([(1, "ctx", "why?")], "id long, context string, question string")
    p = CX.with_request(CX.with_prompt(df, "context", "question")).first()
    assert p.prompt.startswith("Use the following context") and p.prompt.endswith("Question:\nwhy?\n")
    req = json.loads(p.request)
    assert req["messages"][0]["role"] == "system" and req["messages"][1]["content"] == p.prompt
    assert req["temperature"] == 0.7 and req["max_tokens"] == 512
