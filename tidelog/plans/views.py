"""Log-shaped views over the test tables, in text that Spark SQL and DuckDB both read.

The given tables hold no log text, so the view spells one log message per ``events`` row; it grows
with the table. ``suffix`` adds one phrase per row so that every rewrite, tag and label rule meets
matching text.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.session import ROWS_A_TASK, spread

HOST_PATTERN = r"\bnode-\d+-\d+(\.infra\.example\.com)?\b"

_SOURCE = "concat('node-', user_id % 20, '-', user_id % 3, '.infra.example.com')"

_MESSAGE = """concat('Node-', user_id % 20, '-', user_id % 3, '.infra.example.com ',
 case event_type
  when 'error' then case event_id % 4
    when 0 then concat('Hostd[', event_id, ']: Failed to connect to vpxa 10.0.', user_id % 250, '.7: connection refused')
    when 1 then concat('envoy-access[', event_id, ']: upstream request timeout after ', user_id, ' ms')
    when 2 then concat('vmkernel: cpu', user_id % 8, ':', event_id, ' nmp exception h:0x4319', user_id)
    else concat('Vpxa: GET /hgw/host-', user_id, ' returned 403 denied opID=ab-', event_id) end
  when 'signup' then concat('vpxuser login from 10.1.', user_id % 250, '.9 session ', lower(md5(cast(user_id as {string}))))
  when 'purchase' then concat('VMMS: virtual machine ', user_id, ' powered on task-', event_id, ' completed')
  when 'click' then concat('sdrsInjector[', event_id, ']: opening slot count file /vmfs/volumes//ds', user_id, '/slots')
  else concat('The WMI Performance Adapter service entered the running state after ', event_id % 60, ' s vim.RetrieveProperties') end)"""

# One phrase per row, chosen by event_id; SQL expressions common to both engines.
_PHRASES = [
    "concat('mount /vmfs/volumes//store-', user_id, '/.naa.60a98', event_id, '/slots')",
    "concat('on Vol ''Store ', user_id, ''' mounted')",
    "concat('at 2024-03-0', 1 + event_id % 9, 'T10:11:12.', event_id, 'Z done')",
    "concat('disk ', substr(md5(cast(event_id as {string})), 1, 8), '-', substr(md5(cast(user_id as {string})), 1, 4), "
    "'-4abc-8def-', substr(md5(cast(event_id as {string})), 9, 12), ' seen')",
    "concat('dlx: ', event_id, ' sid=ab-', user_id, ' lro-', event_id, ' ended')",
    "concat('call \"RetrieveProperties\" then Query of csi.Volume_Get:', event_id)",
    "concat('  two   blanks\t', 'and a tab ', user_id, '  ')",
    "concat('heap 0XBEEF', event_id % 10, ' cpu', event_id % 16, ' busy')",
    "'Successfully scheduled Software Protection service for restart'",
    "'The start type of the BITS service was changed'",
    "'healthdPlugins heart beat sent'",
    "'FailoverClustering created a checkpoint'",
    "'failover clustering node joined'",
    "'Microsoft-Windows-Hyper-V-VMMS offline downlevel migration succeeded'",
    "'access history in hive cleared'",
    "'POST /sdk by Fdm stopped'",
    "'qualys scan of vSAN'",
    "'vsansystem pywarning setup'",
    "'envoy reuse_port set'",
    "'checking liveness of kmxa'",
    "'esxtokend refreshed certificate'",
    "'snapshot of role administrator'",
    "'vmkwarning: path notfound'",
    "'WinRM timed out'",
    "'Service Control Manager success'",
    "'VMSP unable to reach root'",
]
_SUFFIX = (
    f"case event_id % {len(_PHRASES)} "
    + " ".join(f"when {i} then {p}" for i, p in enumerate(_PHRASES))
    + " else '' end"
)

LOG_COLUMNS = {
    "id": "event_id",
    "ts": "ts",
    "platform": "case when event_id % 3 = 0 then 'hyperv' else 'esxi' end",
    "source": _SOURCE,
    "message": _MESSAGE,
    "user_id": "user_id",
    "event_type_raw": "event_type",
    "value": "value",
}
VARIED_COLUMNS = {**LOG_COLUMNS, "message": f"concat({_MESSAGE}, ' ', {_SUFFIX})"}


def _text(columns: dict[str, str], string_type: str) -> list[str]:
    return [f"{expr.replace('{string}', string_type)} as {name}" for name, expr in columns.items()]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, ts, platform, source, message, user_id, event_type_raw, value: one row per event."""
    return spread(_events(spark, sf_dir), ROWS_A_TASK).selectExpr(*_text(LOG_COLUMNS, "string"))


def varied_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(_events(spark, sf_dir), ROWS_A_TASK).selectExpr(*_text(VARIED_COLUMNS, "string"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """logs + template, service, event_type, predicted_label, risk_score, run_ts."""
    from tidelog.functions.rewrites import template_of
    from tidelog.functions.scoring import risk_score
    from tidelog.functions.tagging import service_of

    label = F.expr(PREDICTED_LABEL.format(type="event_type_raw", id="id"))
    return logs(spark, sf_dir).select(
        "*",
        template_of(F.col("message"), HOST_PATTERN).alias("template"),
        service_of(F.col("message")).alias("service"),
        label.alias("predicted_label"),
        risk_score(label).alias("risk_score"),
        F.expr(RUN_TS).alias("run_ts"),
    )


PREDICTED_LABEL = (
    "case when {type} = 'error' then 'error' when {type} = 'view' and {id} % 50 = 0 then 'anomaly' "
    "when {type} = 'signup' then 'security_noise' when {type} = 'purchase' then 'important' else 'noise' end"
)

# Ingest time: the start of the 15-minute run that saw the event.
RUN_TS = "ts - make_dt_interval(0, 0, minute(ts) % 15, extract(second from ts))"


def now_of(df: DataFrame, ts: str = "ts"):
    """The newest time of the table stands for "now", so results never depend on the wall clock."""
    return df.agg(F.max(ts)).scalar()
