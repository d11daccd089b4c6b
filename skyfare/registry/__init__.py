"""The checked queries: inputs from the driver's tables, operators, equivalent SQL."""
