from quarrymill.plans import registry
from tests.compare import SF


def test_prompts_may_use_four_thousand_tokens(spark):
    used = [r.used for r in registry.QUERIES["context_budget_4000"](spark, SF).collect()]
    assert 800 < max(used) <= 4000
