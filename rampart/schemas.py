"""Fixed schemas of the tables rampart reads and writes."""

from pyspark.sql import types as T

S, L, I, D, B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
NTZ = T.TimestampNTZType()


def _struct(*fields):
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


# Column order of the parsed marker log.
NORMALIZED_COLUMNS = ["id", "RemoteAddress", "RemoteUser", "TimeLocal", "Request", "URL",
                      "Version", "Status", "BodyBytesSent", "Referer", "UserAgent", "token"]

NORMALIZED = _struct(
    ("id", L), ("RemoteAddress", S), ("RemoteUser", S), ("TimeLocal", NTZ), ("Request", S),
    ("URL", S), ("Version", S), ("Status", S), ("BodyBytesSent", S), ("Referer", S),
    ("UserAgent", S), ("token", S),
)

LEGACY = _struct(
    ("id", L), ("remote_addr", S), ("remote_user", S), ("runtime", I), ("time_local", L),
    ("request_type", S), ("request_path", S), ("request_protocol", S), ("status", I),
    ("size", L), ("referer", S), ("user_agent", S),
)

SCORED = T.StructType(NORMALIZED.fields + [
    T.StructField("lenToken", I), T.StructField("lenURL", I),
    T.StructField("anomaly", I), T.StructField("anomaly_score", D)])

CLASSIFIED = T.StructType(SCORED.fields + [
    T.StructField("attack_types", S), T.StructField("critical_alert", B)])

REJECTS = _struct(("id", L), ("value", S), ("reason", S))

BLOCKED = _struct(("RemoteAddress", S))

WHITELIST = _struct(("entry", S))

LABELS = _struct(("column", S), ("label", S), ("code", I))

SCALER = _struct(("column", S), ("mean", D), ("std", D), ("n", L))

FOREST_NODES = _struct(("tree", I), ("node", I), ("feat", I), ("thr", D), ("l", I), ("r", I),
                       ("path", D))

FOREST_PARAMS = T.StructType([
    T.StructField("psi", I), T.StructField("n_trees", I), T.StructField("offset", D),
    T.StructField("seed", L), T.StructField("features", T.ArrayType(S)),
    T.StructField("contamination", D)])

# ---------------------------------------------------------------------------
# Names and labels of the reference's classified CSV, used on
# export so that its readers find them.
EXPORT_NAMES = {"attack_types": "Types d'attaque", "critical_alert": "Alerte Critique"}
CRITICAL_YES, CRITICAL_NO = "Oui", "Non"
# ---------------------------------------------------------------------------
