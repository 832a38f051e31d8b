"""Word lists of the domain: fixed values that results depend on."""

from __future__ import annotations

# --- fixed values -----------------------------------------------------------------------------------------------------------------
MISSPELT = {"guarentees": "guarantees", "guarentee": "guarantee", "guarenteed": "guaranteed", "guarenteeing": "guaranteeing"}

ACTORS = {
    "owner": ("owner", "company", "purchaser", "buyer", "nrg"),
    "contractor": ("contractor", "seller", "subcontractor", "vendor"),
    "authority": ("authority", "authorities", "governmental", "municipal", "agency"),
    "engineer": ("engineer", "designer"),
}
ACTIONS = {
    "permit": ("permit", "permits", "permitting", "approval", "approvals", "license", "licenses", "consent"),
    "pay": ("pay", "pays", "payment", "payments", "compensate", "compensation", "cost", "costs"),
    "guarantee": ("guarantee", "guarantees", "guaranteed", "warrant", "warrants"),
    "terminate": ("terminate", "termination", "end", "cancel", "convenience", "default"),
    "delay": ("delay", "delays", "late", "lateness", "slip", "slippage"),
    "schedule": ("schedule", "milestone", "milestones", "completion", "substantial completion"),
    "define": ("means", "shall mean", "defined", "definition", "definitions"),
    "indemnify": ("indemnify", "indemnity", "hold harmless", "defend"),
    "design": ("design", "engineering", "engineer"),
    "construct": ("construct", "construction", "build", "install", "erect"),
}
TOPICS = {
    "permitting": ("permit", "permits", "permitting", "approval", "approvals", "license", "licenses"),
    "liquidated damages": ("liquidated damages", "late substantial completion", "delay damages", "late completion"),
    "guarantees": ("guarantee", "guarantees", "guaranteed", "performance guarantee", "emission guarantees", "limit", "limits"),
    "emissions": ("emission", "emissions", "nox", "co", "ppmvd", "oxygen"),
    "termination": ("termination", "terminate", "convenience", "default"),
    "weather": ("weather", "severe weather", "adverse weather"),
    "delay": ("delay", "delays", "late", "lateness", "schedule", "completion"),
    "payment": ("pay", "payment", "payments", "compensation", "invoice", "cost", "costs"),
    "responsibility": ("responsible", "responsibility", "obligation", "obligations", "shall", "must", "required"),
    "definition": ("means", "shall mean", "defined as", "definition", "definitions"),
}
EXPANSIONS = {
    "responsible for": ("responsible", "obligation", "obligations", "shall", "must", "required"),
    "who is responsible": ("responsible", "obligation", "shall", "must"),
    "emission guarantees": ("guarantee", "guarantees", "emissions", "shall not exceed", "ppmvd", "nox", "co"),
    "emission guarantee": ("guarantee", "guarantees", "emissions", "shall not exceed", "ppmvd", "nox", "co"),
    "finishes late": ("delay", "delays", "late substantial completion", "liquidated damages"),
    "end the contract": ("terminate", "termination", "convenience", "default"),
    "weather delays": ("weather", "severe weather", "delay", "schedule"),
    "for convenience": ("convenience", "termination"),
}

SYSTEM_SUFFIXES = ("system", "systems")
SYSTEM_HEADS = (
    "system", "pump", "compressor", "turbine", "generator", "motor", "valve", "blower", "fan", "heater", "cooler", "analyzer", "filter", "tank", "vessel", "line", "header", "train",
    "skid", "module", "package", "unit",
)
SYSTEM_FAMILIES = {
    "closed cooling water": ("closed cooling water", "closed cooling water system", "closed cooling water systems", "ccw"),
    "dew point heater": ("dew point heater", "dew point heaters", "dew point heater system", "dew point heater systems"),
}
ATTRIBUTE_ALIASES = {
    "design_conditions": ("design_conditions", "design conditions", "design condition", "operating conditions", "operating condition", "design basis"),
    "configuration": ("configuration", "configured", "arrangement", "arranged", "configuration arrangement", "configuration / arrangement"),
    "size": ("size", "sizes", "diameter", "dimension", "dimensions"),
    "capacity": ("capacity", "capacities", "output", "duty", "throughput"),
    "quantity": ("quantity", "quantities", "number", "count", "counts"),
    "power": ("power", "horsepower", "horse power", "hp", "kw", "kilowatt", "kilowatts", "motor power", "rating", "rated"),
    "pressure": ("pressure", "pressures", "psi", "psig"),
    "temperature": ("temperature", "temperatures"),
    "flow": ("flow", "flows", "flowrate", "flow rate", "throughput"),
    "type": ("type", "kind", "model", "models", "selected", "selection", "manufacturer", "vendor"),
    "service": ("service", "services", "duty", "duties"),
    "definition": ("definition", "defined", "means", "meaning"),
    "responsibility": ("responsibility", "responsibilities", "responsible", "provide", "provided", "supply", "furnish"),
    "function": ("function", "functions", "work", "works", "operate", "operation", "process"),
}
ATTRIBUTE_TERMS = {
    "configuration": ("configuration", "configured", "arrangement"),
    "design_conditions": ("design conditions", "design condition", "design basis", "operating conditions"),
    "type": ("type", "kind", "model", "selected", "manufacturer"),
    "size": ("size", "diameter", "rating", "dimension"),
    "capacity": ("capacity", "output", "duty", "throughput"),
    "quantity": ("quantity", "number", "count"),
    "power": ("horsepower", "horse power", "hp", "kw", "kilowatt", "motor power"),
    "pressure": ("pressure", "pressures", "psi", "psig"),
    "temperature": ("temperature", "temperatures"),
    "flow": ("flow", "flow rate", "flowrate", "throughput"),
    "service": ("service", "services", "duty"),
    "responsibility": ("responsible", "provide", "provided", "supply", "furnish"),
    "definition": ("means", "defined", "definition"),
    "function": ("work", "works", "operate", "operation", "process"),
}
EXACT_VALUE_ATTRIBUTES = ("configuration", "capacity", "quantity", "service", "type", "size", "power", "pressure", "temperature", "flow")

TABLE_HEADERS = ("characteristic", "description", "equipment", "item", "items", "parameter", "qty", "quantity", "remarks", "service", "specification", "unit", "units", "value", "values")
BOILERPLATE_LINES = ("confidential", "execution version")

FACT_ATTRIBUTES = {
    "configuration": ("configuration", "configured", "arrangement"),
    "capacity": ("capacity", "capacities"),
    "quantity": ("quantity", "quantities", "number"),
    "rating": ("rating", "ratings", "rated", "power", "horsepower", "horse power", "hp", "kw", "mw"),
    "model": ("model", "models", "type"),
    "size": ("size", "sizes", "diameter", "dimension", "dimensions", "rating", "ratings"),
    "pressure": ("pressure", "pressures", "psig", "psia", "psi", "bar", "kpa"),
    "temperature": ("temperature", "temperatures", "degf", "degc", "°f", "°c"),
    "flow": ("flow", "flows", "flowrate", "flow rate", "throughput", "gpm", "scfm", "cfm"),
    "service": ("service", "services", "duty", "duties"),
}
FACT_HEADS = ("analyzer", "boiler", "blower", "compressor", "cooler", "fan", "filter", "generator", "heater", "line", "motor", "package", "panel", "pump", "skid", "system", "tank", "train", "turbine", "unit", "valve", "vessel")
FACT_LEADING = ("a", "all", "an", "each", "existing", "new", "selected", "the", "these", "this", "those", "vendor")
FACT_TRAILING = (
    "be", "for", "has", "have", "include", "includes", "including", "is", "provided", "provides", "providing", "service", "shall", "using", "with",
    "configuration", "configured", "capacity", "capacities", "data", "description", "descriptions", "duty", "duties", "list", "lists", "model", "models", "quantity", "quantities",
    "rating", "ratings", "requirements", "schedule", "services", "table", "tables",
)

QUERY_PREFIXES = (
    "summarize the ", "summarize ", "describe the ", "describe ", "summary of ", "give me information about ", "information about ", "give me details about ", "details about ",
    "overview of ", "what does the contract say about ", "what does it say about ", "does the contract mention ", "tell me about ", "show me ", "quote ", "exact ", "what is ",
    "what are ", "define ", "meaning of ",
)
DIRECT_PREFIXES = ("show me ", "quote ", "exact ", "what does the contract say about ", "what does it say about ", "does the contract mention ")
BROAD_PREFIXES = (
    "summarize the ", "summarize ", "describe the ", "describe ", "summary of ", "give me information about ", "information about ", "give me details about ", "details about ",
    "overview of ", "what do we have about ",
)
QUERY_TAILS = ("do we have", "do we use", "are we using", "is used", "are there", "is there", "do we need", "do we require")
STOPWORDS = (
    "a", "an", "about", "any", "all", "and", "are", "by", "contract", "does", "details", "describe", "exact", "for", "from", "give", "how", "information", "in", "is", "it", "many",
    "me", "my", "list", "mention", "provide", "provided", "of", "on", "or", "quote", "required", "say", "show", "summary", "summarize", "tell", "that", "the", "this", "overview",
    "your", "to", "what",
)
SYSTEM_FILLER = (*STOPWORDS, "current", "do", "did", "site", "we", "our", "using", "use", "used", "work", "works")

GENERIC_SYSTEM_TERMS = ("system", "systems", "equipment", "package", "packages", "module", "modules", "unit", "units", "train", "trains", "skid", "skids")
VOCABULARY_HEADS = (
    *GENERIC_SYSTEM_TERMS, "pump", "pumps", "compressor", "compressors", "turbine", "turbines", "generator", "generators", "motor", "motors", "valve", "valves", "blower", "blowers",
    "fan", "fans", "heater", "heaters", "cooler", "coolers", "analyzer", "analyzers", "filter", "filters", "tank", "tanks", "vessel", "vessels", "line", "lines", "header", "headers",
)
LEADING_DESCRIPTORS = ("selected", "existing", "new", "main", "primary", "secondary", "standby", "common", "proposed", "project")
TRAILING_DESCRIPTORS = (
    "description", "descriptions", "installation", "installations", "requirements", "requirement", "details", "detail", "list", "lists", "listing", "schedule", "schedules", "table",
    "tables", "summary", "summaries", "service", "services", "data", "duty", "duties", "device", "devices",
)
TRAILING_ATTRIBUTES = (
    "design conditions", "design condition", "operating conditions", "operating condition", "design basis", "horse power", "flow rate", "flow rates", "type model", "motor list",
    "equipment list", "configuration", "configured", "arrangement", "type", "model", "models", "size", "sizes", "capacity", "capacities", "pressure", "pressures", "temperature",
    "temperatures", "flow", "function", "functions", "responsibility", "responsibilities",
)

REFUSAL = "I can't verify that from the contract."
# ----------------------------------------------------------------------------------------------------------------------------------
