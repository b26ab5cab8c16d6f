"""The model of load_order is made from listings that were joined once."""

from rentloom.cases import relations


def test_tables_of_the_load_order_hold_no_join(spark, sf, monkeypatch):
    seen = {}

    def load(tables, order, root, **jdbc):
        seen.update(tables)
        return list(order)

    monkeypatch.setattr(relations, "load_in_order", load)
    relations.load_order(spark, sf)
    plans = [t._jdf.queryExecution().optimizedPlan().toString() for t in seen.values()]
    assert len(plans) > 10 and not any("Join" in p for p in plans)
