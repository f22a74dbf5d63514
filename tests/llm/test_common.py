from undertow.llm import common


def test_what_an_operator_drops_goes_back_to_the_machine(monkeypatch):
    """Once per change of operator: what the one before remembers is dropped first, then the free memory given back."""
    said = []
    monkeypatch.setattr(common, "_HOLDER", [])
    monkeypatch.setattr(common, "give_back", lambda: said.append("back"))
    first, second = (lambda: said.append("first")), (lambda: said.append("second"))
    common.hold(first)
    common.hold(first)
    assert said == []
    common.hold(second)
    common.hold(second)
    assert said == ["first", "back"]
    common.hold(first)
    assert said == ["first", "back", "second", "back"]


def test_batches_between_engine_and_worker_are_small_beside_an_executor(spark):
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "4194304b"
    common.give_back()
