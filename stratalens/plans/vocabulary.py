"""Closed lists of the estate: kinds of relationship by purpose, weights, statuses.  Fixed values, in their natural order."""

STATUSES = ("confirmed", "inferred", "needs_review")

# Core relationships.
CORE = ("EXECUTES", "CALLS", "USES", "READS", "WRITES", "STARTS")
TRACE_CONTROL = ("CALLS", "EXECUTES", "STARTS")
TRACE_DATA = ("READS", "WRITES", "USES")

# What a change to the target reaches: the source depends on the target.
IMPACT = (
    "CALLS", "DYNAMIC_CALL", "EXECUTES", "CONTAINS_STEP", "USES_PROCEDURE", "USES_COPYBOOK", "READS_TABLE", "WRITES_TABLE",
    "READS_DATASET", "WRITES_DATASET", "USES_DATASET", "READS_FILE", "WRITES_FILE", "STARTS_PROGRAM", "USES_MAP",
    "IMPLEMENTS_RULE", "EXPANDS_TO", "RESOLVES_SYMBOL", "PUTS_MESSAGE", "GETS_MESSAGE", "USES_QUEUE", "CONTAINS_SEGMENT",
    "PARENT_SEGMENT", "SCHEDULES", "TRIGGERS",
)

# Relationships that a driver's chain follows.
CHAIN = (
    "CALLS", "DYNAMIC_CALL", "EXECUTES", "USES_COPYBOOK", "READS_TABLE", "WRITES_TABLE", "READS_FILE", "WRITES_FILE",
    "READS_DATASET", "WRITES_DATASET", "IMPLEMENTS_RULE", "PUTS_MESSAGE", "GETS_MESSAGE",
)

# Relationships that couple programs to each other or to what they share.
COUPLING = (
    "CALLS", "DYNAMIC_CALL", "READS_TABLE", "WRITES_TABLE", "READS_FILE", "WRITES_FILE", "READS_DATASET", "WRITES_DATASET",
    "USES_COPYBOOK", "PUTS_MESSAGE", "GETS_MESSAGE",
)
DATA_ACCESS = ("READS_TABLE", "WRITES_TABLE", "READS_FILE", "WRITES_FILE", "READS_DATASET", "WRITES_DATASET")

# Control and data relationships of the detailed graph.
CONTROL = (
    "CALLS", "DYNAMIC_CALL", "OBSERVED_CALLS", "EXECUTES", "INVOKES_PROC", "STARTS_PROGRAM", "STARTS_TRANSACTION",
    "CONTAINS_PARAGRAPH", "CONTAINS_SECTION", "SECTION_CONTAINS_PARAGRAPH", "CONTAINS_STATEMENT", "CONTAINS_STEP",
    "PERFORMS", "BRANCHES_TO", "DEFINES_BUSINESS_RULE", "DEFINES_TRANSFORMATION", "HANDLES_CICS_CONDITION",
    "DEFINES_CICS_CONTRACT", "DEFINES_FILE_IO", "DEFINES_SORT_MERGE", "EXECUTES_BEFORE", "DEFINES_CONDITION",
    "CONTROLS_STEP", "CONDITION_REFERENCES_STEP", "CONDITION_CHECKS_RETURN_CODE", "EXPANDS_TO_STEP",
    "EXPANDED_FROM_PROC_STEP", "OPENS_DB2_CURSOR", "FETCHES_DB2_CURSOR", "CLOSES_DB2_CURSOR",
)
DATA = (
    "USES_COPYBOOK", "DECLARES_COPYBOOK_FIELD", "FIELD_DERIVED_FROM_COPYBOOK", "USES_COPYBOOK_FIELD", "DECLARES_FIELD",
    "FLOWS_TO", "READS_TABLE", "WRITES_TABLE", "DEFINES_TABLE", "DECLARES_TABLE", "USES_DCLGEN", "DCLGEN_DECLARES_TABLE",
    "INDEXES_TABLE", "DEFINES_DB2_DATABASE", "DEFINES_DB2_BUFFERPOOL", "DEFINES_DB2_TABLESPACE", "DEFINES_DB2_LOCATION",
    "DEFINES_DB2_CURSOR", "CURSOR_READS_TABLE", "CURSOR_READS_COLUMN", "CURSOR_FILTERS_BY_COLUMN",
    "CURSOR_JOINS_ON_COLUMN", "DEFINES_DB2_PACKAGE", "BINDS_PROGRAM", "DEFINES_DB2_PLAN", "USES_DB2_PACKAGE",
    "DEFINES_DB2_STATEMENT", "STATEMENT_READS_TABLE", "STATEMENT_WRITES_TABLE", "STATEMENT_READS_COLUMN",
    "STATEMENT_WRITES_COLUMN", "STATEMENT_FILTERS_BY_COLUMN", "STATEMENT_JOINS_ON_COLUMN",
    "STATEMENT_INPUTS_FROM_HOST_VARIABLE", "STATEMENT_OUTPUTS_TO_HOST_VARIABLE", "HOST_VARIABLE_BINDS_COLUMN",
    "RULE_USES_FIELD", "TRANSFORMATION_INPUT_FIELD", "TRANSFORMATION_OUTPUT_FIELD", "CONTRACT_USES_FIELD",
    "HAS_RECORD_LAYOUT", "RECORD_DECLARES_FIELD", "READS_FILE", "WRITES_FILE", "USES_FILE", "USES_DATASET",
    "READS_DATASET", "WRITES_DATASET", "DECLARES_DD", "BINDS_DATASET", "CATALOG_DESCRIBES_DATASET",
    "CATALOG_ALIASES_DATASET", "USES_QUEUE", "USES_MAP", "DEFINES_FILE", "DEFINES_ASSEMBLER_DSECT",
)
CALL_GRAPH = ("CALLS", "DYNAMIC_CALL", "OBSERVED_CALLS", "EXECUTES", "INVOKES_PROC", "STARTS_PROGRAM", "STARTS_TRANSACTION", "TRIGGERS")
DEPENDENCY = (*CONTROL, *DATA, "TRIGGERS")
DATA_TYPES = ("TABLE", "FILE", "DATASET", "DATASET_IDENTITY", "COPYBOOK", "MQ_QUEUE", "MAP")

# What a change costs by type of asset that depends on it; an unlisted type counts 3, or 2 as a dependency (then halved).
CRITICALITY = {"JOB": 8, "PROGRAM": 6, "TABLE": 8, "DATASET": 5, "TRANSACTION": 10, "MQ_QUEUE": 7}

# Events that writes stand for: verb and confidence.
EVENT_VERBS = {"WRITES_TABLE": ("Updated", 0.68), "WRITES_FILE": ("Produced", 0.68), "WRITES_DATASET": ("Produced", 0.68), "PUTS_MESSAGE": ("Published", 0.8), "STARTS_TRANSACTION": ("Started", 0.68)}
EVENT_READS = ("READS_TABLE", "READS_FILE", "READS_DATASET", "GETS_MESSAGE")
EVENT_NOISE = ("FILE", "TABLE", "DATASET", "QUEUE")

# Words that name no entity of the domain, and words that name attributes.
DOMAIN_STOP = ("PROGRAM", "JOB", "STEP", "FILE", "TABLE", "DATA", "REC", "RECORD", "WS", "INPUT", "OUTPUT", "READ", "WRITE", "COPY", "PROC", "MAIN", "TEMP", "WORK", "AREA", "SQL")
DOMAIN_SUFFIXES = ("ID", "NO", "NUMBER", "CODE", "STATUS", "DATE", "AMOUNT", "BALANCE", "TYPE", "NAME")

# Parts of program names and the words that they stand for.
NAME_WORDS = {
    "CRD": "Card", "CARD": "Card", "PAY": "Payment", "STMT": "Statement", "INT": "Interest", "AUTH": "Authorization",
    "ACCT": "Account", "BAL": "Balance", "POST": "Posting", "UPD": "Update", "COMP": "Computation", "VAL": "Validation",
    "FMT": "Formatting", "GEN": "Generation", "PROC": "Processing", "CALC": "Calculation",
}

# Words of an expression that tell a rule's kind, the first kind that has one; DECISION without.
RULE_KINDS = (
    ("CALCULATION_OR_THRESHOLD", ("LIMIT", "AMOUNT", "BALANCE", "RATE", "INTEREST", "FEE")),
    ("VALIDATION", ("VALID", "STATUS", "ERROR", "INVALID")),
    ("AUTHORIZATION", ("APPROV", "AUTH", "DECLINE", "BLOCK")),
)

# Capabilities and their key words, and abbreviations of words in questions.
CAPABILITY_WORDS = {
    "card activation": ("CARD", "ACTIV", "STATUS", "PIN", "OPEN"),
    "authorization": ("AUTH", "LIMIT", "VALID", "DECLINE", "APPROVE", "FRAUD"),
    "balance inquiry": ("BAL", "BALANCE", "INQ", "INQUIRY"),
    "interest calculation": ("INT", "INTEREST", "APR", "RATE", "ACCRUAL"),
    "fee calculation": ("FEE", "CHARGE", "WAIVE", "ASSESS"),
    "transaction posting": ("POST", "TXN", "TRAN", "LEDGER", "SETTLE"),
    "statement generation": ("STMT", "STATEMENT", "BILL", "CYCLE"),
    "fraud check": ("FRAUD", "RISK", "SCORE", "RULE"),
    "card blocking": ("BLOCK", "HOT", "LOST", "STOLEN", "STATUS"),
    "rewards": ("REWARD", "POINT", "LOYAL", "CASHBACK"),
}
ABBREVIATIONS = {"CUSTOMER": ("CUST",), "ACCOUNT": ("ACCT",), "TRANSACTION": ("TRAN", "TXN"), "VALIDATION": ("VALID", "VAL"), "VALIDATE": ("VALID", "VAL"), "AUTHORIZATION": ("AUTH",), "AUTHORIZE": ("AUTH",)}

# Coverage of an asset's neighbourhood: what each check counts, by kind of relationship.
COPYBOOK_FIELDS = ("DECLARES_COPYBOOK_FIELD", "FIELD_DERIVED_FROM_COPYBOOK", "USES_COPYBOOK_FIELD", "HAS_COPY_SITE", "COPY_SITE_EXPANDS_COPYBOOK", "COPY_SITE_DECLARES_FIELD", "MATERIALIZES_COPYBOOK_FIELD")
CURSORS = ("DEFINES_DB2_CURSOR", "CURSOR_READS_TABLE", "CURSOR_READS_COLUMN", "CURSOR_FILTERS_BY_COLUMN", "CURSOR_JOINS_ON_COLUMN")
STATEMENTS = ("DEFINES_DB2_STATEMENT", "STATEMENT_READS_TABLE", "STATEMENT_WRITES_TABLE", "STATEMENT_READS_COLUMN", "STATEMENT_WRITES_COLUMN", "STATEMENT_FILTERS_BY_COLUMN", "STATEMENT_JOINS_ON_COLUMN", "STATEMENT_INPUTS_FROM_HOST_VARIABLE", "STATEMENT_OUTPUTS_TO_HOST_VARIABLE", "HOST_VARIABLE_BINDS_COLUMN")
COVERED_BY = {
    "control_flow": ("CONTAINS_PARAGRAPH", "CONTAINS_SECTION", "SECTION_CONTAINS_PARAGRAPH", "CONTAINS_STATEMENT", "PERFORMS", "BRANCHES_TO", "EXECUTES_BEFORE"),
    "db2_sql": ("READS_TABLE", "WRITES_TABLE", "DECLARES_TABLE", "USES_DCLGEN", "DCLGEN_DECLARES_TABLE", "DEFINES_TABLE", *CURSORS, "DEFINES_DB2_PACKAGE", "DEFINES_DB2_PLAN", "USES_DB2_PACKAGE", *STATEMENTS),
    "db2_cursor_model": (*CURSORS, "OPENS_DB2_CURSOR", "FETCHES_DB2_CURSOR", "CLOSES_DB2_CURSOR"),
    "db2_package_model": ("DEFINES_DB2_PACKAGE", "BINDS_PROGRAM", "DEFINES_DB2_PLAN", "USES_DB2_PACKAGE"),
    "db2_statement_model": STATEMENTS,
    "db2_dclgen": ("USES_DCLGEN", "DCLGEN_DECLARES_TABLE"),
    "jcl_proc_conditions": ("INVOKES_PROC", "DEFINES_CONDITION", "CONTROLS_STEP", "CONDITION_REFERENCES_STEP", "CONDITION_CHECKS_RETURN_CODE", "EXPANDS_TO_STEP", "EXPANDED_FROM_PROC_STEP"),
    "jcl_dd_binding": ("DECLARES_DD", "BINDS_DATASET", "USES_DATASET", "READS_DATASET", "WRITES_DATASET"),
    "copybook_field_ownership": COPYBOOK_FIELDS,
    "assembler": ("DEFINES_ASSEMBLER_DSECT",),
    "cics": ("DEFINES_CICS_CONTRACT", "DEFINES_COMMAREA_CONTRACT", "HANDLES_CICS_CONDITION", "CONTRACT_USES_FIELD", "COMMAREA_CONTAINS_FIELD"),
    "cics_contracts": ("DEFINES_CICS_CONTRACT", "CONTRACT_USES_FIELD"),
    "commarea_contracts": ("DEFINES_COMMAREA_CONTRACT", "COMMAREA_CONTAINS_FIELD"),
    "interface_contract_model": ("DECLARES_ENTRY_CONTRACT", "ENTRY_CONTRACT_USES_FIELD", "DEFINES_CALL_CONTRACT", "CALL_CONTRACT_TARGETS", "CALL_PASSES_FIELD", "CALL_ARGUMENT_MAPS_TO_LINKAGE", "CONTRACT_USES_FIELD"),
    "dataset_identity": ("NORMALIZES_TO_DATASET_IDENTITY", "READS_DATASET_IDENTITY", "WRITES_DATASET_IDENTITY", "USES_DATASET_IDENTITY", "BINDS_DATASET_IDENTITY", "CATALOG_DESCRIBES_DATASET", "CATALOG_ALIASES_DATASET"),
    "catalog_reconciliation": ("CATALOG_DESCRIBES_DATASET", "CATALOG_ALIASES_DATASET"),
    "business_rule_graph": ("DEFINES_BUSINESS_RULE", "RULE_USES_FIELD", "DEFINES_TRANSFORMATION", "TRANSFORMATION_INPUT_FIELD", "TRANSFORMATION_OUTPUT_FIELD"),
    "file_io_semantics": ("DEFINES_FILE_IO", "HAS_RECORD_LAYOUT", "RECORD_DECLARES_FIELD", "READS_FILE", "WRITES_FILE", "USES_FILE"),
    "statement_ordering": ("CONTAINS_STATEMENT", "EXECUTES_BEFORE", "CONTAINS_SECTION", "SECTION_CONTAINS_PARAGRAPH"),
    "sort_merge": ("DEFINES_SORT_MERGE",),
}
CHECKS = (
    "parser", "copybooks", "call_contracts", "runtime_observations", "data_dictionary", "field_lineage", "control_flow",
    "db2_sql", "db2_cursor_model", "db2_package_model", "db2_statement_model", "db2_dclgen", "jcl_proc_conditions",
    "jcl_dd_binding", "copybook_field_ownership", "bounded_copybook_layout", "pli", "assembler", "cics", "cics_contracts",
    "commarea_contracts", "interface_contract_model", "dataset_identity", "catalog_reconciliation", "business_rules",
    "business_rule_graph", "file_io_semantics", "statement_ordering", "sort_merge",
)
COVERAGE_CONFIDENCE = {"captured": 0.9, "partial": 0.65, "needs_review": 0.35, "not_observed": 0.5}

# Types of what assets hold inside, or are described by; changes are weighed between assets.
INNER_TYPES = (
    "FIELD", "SECTION", "PARAGRAPH", "STATEMENT", "BUSINESS_RULE", "TRANSFORMATION", "DB2_CURSOR", "DB2_STATEMENT", "CICS_CONTRACT",
    "COMMAREA_CONTRACT", "INTERFACE_CONTRACT", "FILE_IO_OPERATION", "FILE_RECORD", "SORT_MERGE_OPERATION", "COPYBOOK_FIELD", "JOB_STEP",
    "JCL_DD", "JCL_CONDITION", "ASSEMBLER_DSECT", "DB2_COLUMN", "DB2_INDEX", "RETURN_CODE", "CICS_CONDITION", "DATASET_IDENTITY", "SQL_SCRIPT",
)
