"""Runs from templates: containers, images, secrets, and the event of a template that is missing."""

from fleetwright.operators.assembly import assembled_runs, failed_runs, run_images
from fleetwright.operators.parameters import variables


def test_run_is_made_from_its_template(spark):
    streams = spark.sql(
        "SELECT 'n' AS namespace, x AS name, 'K' AS kind, 'g/v1' AS api_version, 'u' AS uid, 'BatchJobBackend' AS backend, "
        "'Running' AS phase, '{}' AS spec_json, CAST(NULL AS STRING) AS request_name, CAST(NULL AS STRING) AS request_class "
        "FROM VALUES ('a'), ('b'), ('c') AS t(x)"
    )
    resolved = spark.createDataFrame(
        [("n", "a", "tn", "t1", None), ("n", "b", "tn", "lost", None), ("n", "c", None, None, "no such template")],
        "namespace string, name string, template_namespace string, template_name string, error string",
    )
    templates = spark.sql(
        "SELECT 'tn' AS namespace, 't1' AS name, array(named_struct('name', 'main', 'image', 'i1', 'limits', map('cpu', '1')), "
        "named_struct('name', 'side', 'image', 'i2', 'limits', map('cpu', '1'))) AS containers"
    )
    secrets = spark.createDataFrame(
        [("n", "a", 1, "s2"), ("n", "a", 0, "s1"), ("n", "a", 2, None)],
        "namespace string, name string, position int, secret_name string",
    )
    built = assembled_runs(streams, resolved, templates, secrets)
    assert sorted(map(tuple, run_images(built).select("name", "container", "image", "secret_names").collect())) == [
        ("a", "main", "i1", "s1,s2"), ("a", "side", "i2", "s1,s2")
    ]
    found = variables(built).filter("container = 'side'").orderBy("position").select("variable", "value").collect()
    assert [tuple(r) for r in found][:3] == [
        ("STREAMCONTEXT__STREAM_ID", "a"), ("STREAMCONTEXT__STREAM_KIND", "K"), ("STREAMCONTEXT__SPEC", "{}")
    ]
    assert [(r["name"], r.event_reason, r.message) for r in failed_runs(resolved, templates).collect()] == [
        ("b", "FailedCreateJob", "failed to create job: failed to get template (tn/lost)")
    ]
