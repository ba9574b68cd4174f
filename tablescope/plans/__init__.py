"""Plans: driver-table stand-ins, chart templates, registered queries and their SQL oracles."""
