"""Readers of text formats."""

import pytest

from locusloom.sources import text


def test_covariates_are_read_whole_or_not_at_all(spark, tmp_path):
    path = tmp_path / "covariates.txt"
    path.write_text("id a b\n" + "c 1 2\n" * 99_999)
    assert len(text.covariates(spark, str(path), ["b", "a"])) == 99_999
    path.write_text("id a b\n" + "c 1 2\n" * 100_000)
    with pytest.raises(ValueError, match="100000 lines"):
        text.covariates(spark, str(path), ["b", "a"])
