"""Queries of the database tools over whole tables."""

import hashlib

from dumpquarry.plans import database


def test_redaction_meets_dirty_emails(spark, tmp_path):
    values = ["a@b.org", None, "", "no-at", "@b.org", "x\ny@b.org", "x@b.org\n", "a@b@c.org", "a@"]
    spark.createDataFrame(list(enumerate(values)), "id long, email string").write.parquet(str(tmp_path / "users.parquet"))

    def wanted(v):
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        if v is None or "@" not in v:
            return v if v is None else digest(v)[:16]
        local, _, domain = v.rpartition("@")
        return digest(local)[:8] + "@" + domain

    got = dict(map(tuple, database.QUERIES["redact_hash_domain_whole"](spark, str(tmp_path)).collect()))
    assert got == {i: wanted(v) for i, v in enumerate(values)}


def test_model_is_inferred_from_all_tables(spark):
    got = {(r.table_name, r.column_name): r.generator for r in database.QUERIES["infer_star_model"](spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == sum(len(t.columns) for t in database.STAR)
    assert {got[k] for k in (("orders", "o_orderstatus"), ("lineitem", "l_returnflag"), ("events", "event_type"))} == {"weighted_choice"}
