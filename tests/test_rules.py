"""Rewrites, tags and labels on hand-written cases."""

from pyspark.sql import functions as F

from tidelog.functions import labeling, rewrites, tagging

HOST = r"\bnode-\d+-\d+(\.infra\.example\.com)?\b"


def values(spark, make, cases):
    """make(columns...) for every case, in one query."""
    width = len(cases[0])
    names = [f"c{i}" for i in range(width)]
    rows = [(n, *case) for n, case in enumerate(cases)]
    df = spark.createDataFrame(rows, "n int, " + ", ".join(f"{c} string" for c in names))
    return [r["x"] for r in df.orderBy("n").select(make(*[F.col(c) for c in names]).alias("x")).collect()]


def check(spark, make, cases):
    got = values(spark, make, [case[:-1] for case in cases])
    assert got == [case[-1] for case in cases]


def test_template(spark):
    cases = [
        (None, ""),
        ("", ""),
        ("   ", ""),
        ("Node-33-2.infra.example.com hostd[2097551]: Failed", "<HOST> hostd[<NUM>]: failed"),
        ("at 2024-03-01T10:11:12.5Z ok", "at <TIMESTAMP> ok"),
        ("task a7b234d4-e5f6-7890-abcd-ef12345678901 completed", "task <UUID> completed"),
        ("login from 127.0.0.1", "login from <IP>"),
        ("h:0x4319ABC x", "h:<HEX> x"),
        ("cpu3:17 y", "cpu<NUM>:<NUM> y"),
        ("dlx: 55 opID=ab-1 sid=q-9 lro-7 task-8", "dlx:<NUM> opid=<ID> sid=<ID> lro-<NUM> task-<NUM>"),
        ("file /vmfs/volumes//vSAN/file", "file /vmfs/volumes//<DATASTORE>/file"),
        ("dev x.naa.600a/b", "dev x.naa.<ID>/b"),
        ("on Vol 'My Store' up", "on vol '<DATASTORE>' up"),
        ("a \t b\nc", "a b c"),
        ("über 12 Ärger", "über <NUM> ärger"),
    ]
    check(spark, lambda c: rewrites.template_of(c, HOST), cases)


def test_second_pass(spark):
    cases = [
        (None, None),
        ("", None),
        ("  ", None),
        ("vim.RetrieveProperties x", "vim.<API_METHOD> x"),
        ('call "Login" now', 'call "<API_METHOD>" now'),
        ("please query it", "please <API_METHOD> it"),
        ("id 0123456789abcdef z", "id <ID> z"),
        ("u 01234567-89ab-cdef-0123-456789abcdef", "u <UUID>"),
        ("n 12", "n <NUM>"),
    ]
    check(spark, rewrites.second_pass, cases)


def test_second_pass_is_idempotent(spark):
    texts = ["vim.A 12 query", 'x "logout" 0123456789abcdef', "a 01234567-89ab-cdef-0123-456789abcdef"]
    once = values(spark, rewrites.second_pass, [(t,) for t in texts])
    assert values(spark, rewrites.second_pass, [(t,) for t in once]) == once


def test_service(spark):
    cases = [
        (None, "unknown"),
        ("The Print Spooler service entered the running state", "Print Spooler"),
        ("Successfully scheduled Software Protection service", "Software Protection"),
        ("The start type of the BITS service was changed", "BITS"),
        ("HOSTD and vpxa", "Hostd"),
        ("healthdPlugins", "healthd"),
        ("Microsoft-Windows-Hyper-V-VMMS", "VMMS"),
        ("Microsoft-Windows-Hyper-V-Worker", "Hyper-V"),
        ("failover clustering up", "FailoverClustering"),
        ("nothing", "unknown"),
    ]
    check(spark, tagging.service_of, cases)


def test_event_type(spark):
    cases = [
        (None, "other"),
        ("Timed out with error", "timeout"),
        ("403 error", "permission_error"),
        ("FAILED", "error"),
        ("heart beat", "heartbeat"),
        ("service entered the running state", "service_start"),
        ("service entered the stopped state", "service_stop"),
        ("created and completed", "task_created"),
        ("status success", "task_success"),
        ("GET /hgw/x", "api_request"),
        ("access history in hive x", "registry_activity"),
        ("start type of x", "service_config_change"),
        ("offline downlevel migration succeeded", "migration_success"),
        ("plain", "other"),
    ]
    check(spark, tagging.event_type_of, cases)


def test_label(spark):
    cases = [
        (None, None, None, "noise"),
        ("all fine", "failure", "", "error"),
        ("failed login", "", "", "error"),
        ("session of error", "", "", "error"),
        ("scan", "", "Qualys agent", "security_noise"),
        ("esxtokend up", "", "", "security_noise"),
        ("session created", "", "", "security_noise"),
        ("pywarning started", "", "", "noise"),
        ("powered on", "", "sdrsInjector", "noise"),
        ("checking liveness task", "", "", "noise"),
        ("job on <DATASTORE>", "other", "", "noise"),
        ("job on <DATASTORE>", "task_success", "", "important"),
        ("group policy updated", "", "", "noise"),
        ("vim.<API_METHOD> completed", "", "", "noise"),
        ("x", "task_start", "", "important"),
        ("vm migrated", "", "", "important"),
        ("x", "heartbeat", "", "noise"),
    ]
    check(spark, labeling.weak_label, cases)


def test_review_reason(spark):
    cases = [
        ("x", "permission_error", "y", "event_type_permission_error"),
        ("vpxuser", "permission_error", "", "event_type_permission_error,security_keyword"),
        ("x", "y", "Root service", "security_keyword"),
        (None, None, None, ""),
    ]
    check(spark, labeling.review_reason, cases)


def test_rewrites_stay_in_the_jvm(spark, sf_dir):
    from tidelog.plans.catalog import QUERIES

    for name in ["normalize_events", "weak_labels", "label_templates", "rewrite_template"]:
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan, name
