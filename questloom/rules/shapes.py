"""Word lists and patterns about answer shapes."""

# Fixed values.
SANITISE_TOKENS = ("", "null", "none", "nan", "inf", "-inf", "infinity", "-infinity")
PACKED_SCORE = r"^\s*(\d+)\s*[-:]\s*(\d+)\s*$"
PERCENT_CELL = r"^([-+]?\d+(?:\.\d+)?)\s*%$"
MANY_MARKERS = (
    " and ", ",", " with ", " along with ", " together with ", " as well as ", "their ",
)
FIELD_TERMS = (
    " id", " name", " sex", " gender", " date", " amount", " cost", " diagnosis", " disease",
    " type", " status", " category", " reference name", " website", " web site", " url", " link",
)
ENTITY_TERMS = (
    "event", "transaction", "trans", "client", "patient", "customer", "account", "record",
    "member", "employee", "product", "item",
)
TRANSACTION_COLUMNS = ("trans_id", "transaction_id", "id")
ENTITY_COLUMNS = ("{e}_name", "{e} name", "{e}_id", "{e} id", "name", "id")
EVENT_COLUMNS = ("event_name", "event name", "name", "event_id", "event id")
COUNT_COLUMNS = ("count", "cnt", "tally", "total", "frequency", "freq", "n")
TALLY_PREFERRED = ("element", "type", "category", "name", "id")
