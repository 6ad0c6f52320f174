import os

from marlstone.operators.tables import free, materialize, owned


def there(table):
    return os.path.exists(table._marlstone_path.removeprefix("file:"))


def test_scopes_delete_what_they_own(spark):
    before = materialize(spark.range(3), "t")
    with owned(spark):
        inner = materialize(spark.range(5), "t")
        lasting = materialize(inner.withColumnRenamed("id", "k"), "t", outlives=True)
        with owned(spark):
            outer = materialize(spark.range(2), "t", outlives=True)
            innermost = materialize(spark.range(2), "t")
        assert there(outer) and not there(innermost)
        freed = materialize(spark.range(2), "t")
        free(freed)
        assert not there(freed)
    assert not there(inner) and not there(outer) and there(before)
    assert lasting.count() == 5 and before.count() == 3
    free(before, lasting)
    assert not there(before) and not there(lasting)


def test_a_failed_scope_leaves_nothing(spark):
    kept = []
    try:
        with owned(spark):
            kept.append(materialize(spark.range(2), "t"))
            raise ValueError
    except ValueError:
        assert not there(kept[0])
