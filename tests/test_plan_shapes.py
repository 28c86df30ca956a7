"""Plan checks: the DataFrame operators stay JVM-side.

Only the documented Arrow kernels may put a Python node in a plan: the kNN
block task (kNN, SMOTE), the moment matrices behind correlations, and model-level jobs (fits, explanations, sweeps), which are not
built here.
"""

import pytest

from conftest import SF0001

from eventlens.plans.catalog import QUERIES

MODEL_LEVEL = {"train_random_forest", "train_gbt", "train_adaboost", "train_rusboost", "train_logit",
               "train_svm", "train_mlp", "one_shot", "grid_sweep", "per_model_configs", "explain_models",
               "shapley_sampling", "tree_shapley", "explanation_run", "render_best", "logit_analysis", "backward_select", "wald_table", "svm_weights",
               "background_kmeans", "vif_prune", "odds_ratios", "wald_one_flag", "odds_one_flag"}
ARROW_ALLOWED = {"knn_join", "smote", "corr_matrix", "corr_prune", "target_corr", "sort_by_abs"}
PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas",
                "FlatMapCoGroupsInPandas", "PythonUDF", "MapInArrow")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - MODEL_LEVEL))
def test_no_python_nodes(spark, name):
    plan = QUERIES[name](spark, SF0001)._jdf.queryExecution().executedPlan().toString()
    found = [n for n in PYTHON_NODES if n in plan]
    if name in ARROW_ALLOWED:
        return
    assert not found, f"{name} runs Python: {found}"


def test_scans_prune_columns(spark):
    """A projection of two lineitem columns reads two columns."""
    plan = QUERIES["child_rollup"](spark, SF0001)._jdf.queryExecution().executedPlan().toString()
    schema = plan.split("ReadSchema: ")[1].split("\n")[0]
    assert schema.count(":") <= 4, schema
