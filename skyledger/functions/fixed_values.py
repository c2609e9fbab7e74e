"""Names and lists that must equal those of the event feeds."""

# Raw event names.
EVENT_NAMES = (
    "FLTPLN", "FPUPDT", "CANCEL", "DELETE", "DESK", "FUEL", "GATE", "LOADPLAN", "LOCK", "PSGRLOAD",
    "UNLOCK", "UNKNOWN", "SIGNFLTPLAN", "M58", "CREW", "CREATE", "CYCLE", "DB", "DCSN", "ETD",
    "DIVERSION", "EQLINK", "GROUNDTIME", "EQSUB", "EON", "ETO", "ETA", "IN", "OFF", "ON", "OUT", "OVR",
    "REINSTATE", "XPE", "RETURN", "RTD", "SKDCHNG", "STUB", "UNSTUB", "STUBSTA", "UNSTUBSTA", "UNFLY",
    "DCS", "CONTINUATION",
)

# Event groups.
PLAN_EVENTS = ("FLTPLN", "FPUPDT")
FULL_EVENTS = ("CREATE", "CYCLE", "DB")
STUB_EVENTS = ("STUB", "UNSTUB", "STUBSTA", "UNSTUBSTA")
TIMES_KEY_ONLY = (
    "CANCEL", "DELETE", "DESK", "FUEL", "GATE", "LOADPLAN", "LOCK", "PSGRLOAD", "UNLOCK", "UNKNOWN",
    "SIGNFLTPLAN", "M58", "CREW",
)
STATUS_KEY_ONLY = (
    "DCS", "DESK", "EQLINK", "EQSUB", "FUEL", "GATE", "GROUNDTIME", "LOCK", "PSGRLOAD", "SKDCHNG",
    "UNLOCK", "SIGNFLTPLAN", "CREW", "UNKNOWN",
)
EQUIPMENT_EVENTS = (
    "CREATE", "CYCLE", "DB", "CONTINUATION", "DIVERSION", "EQLINK", "EQSUB", "FLTPLN", "RETURN",
    "REINSTATE", "RTD", "XPE", "STUB", "UNSTUB", "STUBSTA", "UNSTUBSTA", "LOADPLAN",
)
TAXI_EVENTS = (
    "DCSN", "ETD", "DIVERSION", "EON", "ETO", "ETA", "IN", "OFF", "ON", "OUT", "REINSTATE", "XPE",
    "STUBSTA", "UNSTUBSTA", "UNFLY",
)
NEXT_LEG_EVENTS = ("CONTINUATION", "DIVERSION", "EQLINK", "EQSUB", "RETURN", "REINSTATE", "RTD")
PREV_LEG_EVENTS = ("CONTINUATION", "EQLINK", "EQSUB", "REINSTATE", "XPE", *STUB_EVENTS)
NO_FLIGHT = "0000"

# Leg statuses that mean cancelled, and those that raise a cancel event.
CANCELLED = ("CANCELLED", "CANCELLED_VIA_XL", "CANCELLED_VIA_PLAN")
CANCEL_EVENT_STATUSES = ("CANCELLED", "CANCELLED_VIA_XL")

# Change event type -> tracked column.
TIMES_CHANGES = {
    "ETA": "lta_ms",
    "ETD": "ltd_ms",
    "EON": "eon_ms",
    "ETO": "eto_ms",
    "ACTUAL_OFF_CHANGE": "off_ms",
    "ACTUAL_ON_CHANGE": "on_ms",
    "ACTUAL_OUT_CHANGE": "out_ms",
    "ACTUAL_IN_CHANGE": "in_ms",
    "GROUND_TIME_CHANGE": "ogt_min",
    "ARR_DLY_EVENT": "arr_delay_min",
    "DEP_DLY_EVENT": "dep_delay_min",
}
POSITIVE_ONLY = ("ARR_DLY_EVENT", "DEP_DLY_EVENT")
STATUS_CHANGES = {
    "DEPARTURE_STATUS_CHANGE": "dep_status",
    "ARRIVAL_STATUS_CHANGE": "arr_status",
    "LEG_STATUS_CHANGE": "leg_status",
    "FLT_RELEASE_STATUS_CHANGE": "release_status",
}
EQUIPMENT_CHANGES = {
    "TAIL": "tail",
    "EQUIP_PREVLEG_CHANGE": "prev_leg",
    "EQUIP_NEXTLEG_CHANGE": "next_leg_key",
    "EQUIP_TYPE_CHANGE": "assigned_type",
}

# Event types consumed by the delay processor, then the cancel type.
DELAY_TYPES = (
    "DEP_DLY_EVENT",
    "ARR_DLY_EVENT",
    "GROUND_TIME_CHANGE",
    "CREW_CABIN_DLY_EVENT",
    "CREW_COCKPIT_DLY_EVENT",
    "EQUIP_PREVLEG_CHANGE",
    "ACTUAL_OFF_CHANGE",
    "ACTUAL_ON_CHANGE",
    "ACTUAL_OUT_CHANGE",
    "ACTUAL_IN_CHANGE",
    "CANCEL",
)

# Request types of what-if runs.
WHATIF_REQUESTS = ("HEATWHATIF", "HEATWHATIF_NOACTION", "SWAP_WHATIF")
