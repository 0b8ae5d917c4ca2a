import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_nested_loop_or_cartesian_joins(spark):
    from retrieva.plans import catalog
    for name, run in catalog.QUERIES.items():
        plan = _plan(run(spark, SF))
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


def test_the_index_build_moves_counts_only(spark):
    plan = _plan(E.queries()["e1_corpus_bleu"](spark, SF))
    assert plan.count("Exchange hashpartitioning") <= 2
    from retrieva.operators import sparse
    from retrieva.plans import bindings as B
    kept = sparse._kept_tokens(B.corpus(spark, SF), "doc_id", "content", ())
    assert _plan(sparse.corpus_counts(kept)).count("Exchange hashpartitioning") == 1


def test_topk_plans_limit_before_the_shuffle(spark):
    df = E.queries()["w1_dense_topk"](spark, SF)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in final and "Partial" in final


def test_scans_read_only_needed_columns(spark):
    plan = _plan(E.queries()["p1_path_stem"](spark, SF))
    assert "ReadSchema: struct<page_id:bigint,url:string>" in plan
