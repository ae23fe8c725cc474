"""Audit findings of small files."""

from __future__ import annotations

from tidemark.sources import audit


def test_audit(spark, tmp_path):
    good, bad, empty = tmp_path / "a.csv", tmp_path / "b.csv", tmp_path / "c.csv"
    good.write_text("keyword,volume\n" + "".join(f'"k {i}",{i}\n' for i in range(11)) + '"k, x",1\n')
    bad.write_text("keyword,volume,difficulty\n" + "a,-1,5\n" * 10 + "b,2\nc,1,2,3\n")
    empty.write_text("")
    got = audit.audit(spark, [good, bad, empty, tmp_path / "d.csv"], brands=("", "ab"), client_domain="no domain")
    found = {(r.category, r.file and r.file[-5:]) for r in got.collect()}
    assert {("row_column_mismatch", "b.csv"), ("inconsistent_column_count", "b.csv"), ("negative_volume", "b.csv"), ("many_duplicates", "b.csv"), ("empty_file", "c.csv"), ("file_missing", "d.csv")} <= found
    assert {("empty_brand", None), ("short_brand", None), ("malformed_domain", None)} <= found
    assert not any(f == "a.csv" for _, f in found)
    assert audit.exit_code(got) == 1 and audit.exit_code(audit.audit(spark, [good])) == 0
