"""Record layouts of the two telecom streams and the window micro-test.

Both streams are positional, delimited, header-less text.  Every column is
read as a string (the declared widths are kept as column metadata: Spark does
not accept VARCHAR(n) in a read schema); typed variants promote a few columns.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: column order and declared VARCHAR width of each record ---
# (must equal the upstream record layouts for positional parsing to work)

FLOWS_COLUMNS = [
    ("load_ts", 32), ("eventtime", 32), ("creationtime", 32), ("lastaccesstime", 32), ("flowid", 8),
    ("bearerid", 4), ("sessionid", 16), ("recordtype", 32), ("reserved00", 4), ("reserved01", 4),
    ("reserved02", 4), ("reserved03", 4), ("protocol", 4), ("uplinkoctets", 16),
    ("uplinkpackets", 16), ("downlinkoctets", 16), ("downlinkpackets", 16),
    ("uplinkdropoctets", 16), ("uplinkdroppackets", 16), ("downlinkdropoctets", 16),
    ("downlinkdroppackets", 16), ("dpiapplication", 32), ("dpirealprotocol", 16),
    ("protoinfoprotocol", 4), ("subprotocoltype", 4), ("subprotocolvalue", 8),
    ("operatingsystem", 16), ("operatingsystemversion", 8), ("im_si", 16),
    ("uplinkretranspackets", 8), ("uplinkretransbytes", 8), ("downlinkretranspackets", 8),
    ("downlinkretransbytes", 8), ("initialrtt", 8), ("httpttfbtime", 8),
    ("dpiprotocolattributes", 16), ("dpitransferredcontent", 16), ("dpilayer7protocol", 4),
    ("applicationattributes", 4), ("ulinitrtttime", 8), ("dlinitrtttime", 8),
    ("ulflowactivityduration", 8), ("dlflowactivityduration", 16), ("ulflowpeakthroughput", 8),
    ("dlflowpeakthroughput", 8), ("ulsessionactivityduration", 8), ("dlsessionactivityduration", 8),
    ("ulsessionpeakthroughput", 8), ("dlsessionpeakthroughput", 8), ("bucketname", 4),
    ("bucketmin", 8), ("bucketmax", 8), ("buckettime", 8), ("bucketdirection", 4),
    ("tetheringentitled", 8), ("tetheredflow", 8), ("tetheringalgorithm", 4),
    ("protoinfosubprotocol", 4), ("closurereason", 16), ("cplanesessionid", 8), ("qualityindex", 4),
    ("reserved1", 4), ("reserved2", 4), ("reserved3", 4), ("reserved4", 4), ("reserved5", 4),
    ("reserved6", 4), ("reserved7", 4), ("reserved8", 4), ("reserved9", 4), ("reserved10", 4),
    ("data_dt", 16),
]

SESSIONS_COLUMNS = [
    ("load_ts", 32), ("sessionid", 8), ("eventtime", 32), ("recordtype", 32), ("gwtype", 32),
    ("im_si", 16), ("msisdn", 16), ("imeisv", 32), ("meid", 4), ("mnnai", 4), ("reserved00", 4),
    ("pdptype", 32), ("timezone", 4), ("dst", 4), ("pdnconnectionid", 8), ("accessoutintftype", 32),
    ("reserved01", 4), ("accessoutteid", 16), ("accessinintftype", 32), ("reserved02", 4),
    ("accessinteid", 8), ("networkoutintftype", 4), ("networkoutipaddress", 4),
    ("networkoutteid", 8), ("networkinintftype", 4), ("networkinipaddress", 4),
    ("networkinteid", 8), ("starttime", 32), ("stoptime", 8), ("nodeaddress", 16),
    ("nodeipaddrtype", 32), ("nodetype", 32), ("nodeplmnidmcc", 8), ("nodeplmnidmnc", 8),
    ("apnid", 8), ("rattype", 32), ("gwaddress", 16), ("gwipaddrtype", 32), ("gwnodeid", 16),
    ("gwplmnidmcc", 8), ("gwplmnidmnc", 8), ("recordtriggercause", 4), ("uplinkoctets", 16),
    ("uplinkpackets", 16), ("downlinkoctets", 16), ("downlinkpackets", 16),
    ("uplinkdropoctets", 16), ("uplinkdroppackets", 16), ("downlinkdropoctets", 16),
    ("downlinkdroppackets", 16), ("triggercause", 32), ("closeinfoinit", 4),
    ("closeinfocausecode", 8), ("gtpcausecodeforattempts", 4), ("mbruplink", 8),
    ("mbrdownlink", 16), ("csgid", 8), ("csgaccessmode", 8), ("csgmembership", 8), ("cgimnc", 8),
    ("cgici", 8), ("cgimcc", 8), ("cgilac", 8), ("laimnc", 8), ("laimcc", 8), ("lailac", 8),
    ("saimnc", 8), ("saisac", 8), ("saimcc", 8), ("sailac", 8), ("raimnc", 8), ("rairac", 8),
    ("raimcc", 8), ("railac", 8), ("taimnc", 8), ("taitac", 8), ("taimcc", 8), ("ecgimnc", 8),
    ("ecgieci", 16), ("ecgimcc", 8), ("locextclosereason", 8), ("ulsessionactivityduration", 16),
    ("dlsessionactivityduration", 16), ("ulsessionpeakthroughput", 16),
    ("dlsessionpeakthroughput", 16), ("aggrtime", 32), ("bucketname", 16), ("bucketmin", 4),
    ("bucketmax", 8), ("buckettime", 8), ("bucketdirection", 8), ("uplanesessionid", 8),
    ("realapn", 8), ("reserved1", 4), ("reserved2", 4), ("reserved3", 4), ("reserved4", 4),
    ("reserved5", 4), ("reserved6", 4), ("reserved7", 4), ("reserved8", 4), ("data_dt", 16),
]

# the eight tonnage columns, in record order
TONNAGE = [
    "uplinkoctets", "uplinkpackets", "downlinkoctets", "downlinkpackets",
    "uplinkdropoctets", "uplinkdroppackets", "downlinkdropoctets", "downlinkdroppackets",
]
OCTETS = ["uplinkoctets", "downlinkoctets", "uplinkdropoctets", "downlinkdropoctets"]
PACKETS = ["uplinkpackets", "downlinkpackets", "uplinkdroppackets", "downlinkdroppackets"]
# --- end of fixed values ---

assert len(FLOWS_COLUMNS) == 72 and len(SESSIONS_COLUMNS) == 102


def _string_schema(columns: list[tuple[str, int]], typed: dict[str, T.DataType] | None = None
                   ) -> T.StructType:
    typed = typed or {}
    fields = []
    for name, width in columns:
        dtype = typed.get(name, T.StringType())
        fields.append(T.StructField(name, dtype, True, {"varchar": width}))
    return T.StructType(fields)


def flows_schema(typed: bool = False) -> T.StructType:
    """72-column flows schema; ``typed`` reads ``sessionid`` as INT (sharded catalog)."""
    return _string_schema(FLOWS_COLUMNS, {"sessionid": T.IntegerType()} if typed else None)


def sessions_schema(typed: bool = False) -> T.StructType:
    """102-column sessions schema; ``typed`` reads ``load_ts`` TIMESTAMP and ``sessionid`` INT."""
    extra = {"load_ts": T.TimestampType(), "sessionid": T.IntegerType()} if typed else None
    return _string_schema(SESSIONS_COLUMNS, extra)


TESTWINDOW_SCHEMA = T.StructType([
    T.StructField("event_time", T.TimestampType(), True),
    T.StructField("c1", T.StringType(), True, {"varchar": 4}),
])


def with_corrupt_column(schema: T.StructType, name: str = "_corrupt_record") -> T.StructType:
    return T.StructType(list(schema.fields) + [T.StructField(name, T.StringType(), True)])
