"""The registered queries, their SQL equivalents and the traces both run on."""
