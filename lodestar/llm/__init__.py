"""Training-data operators: tokenising, personal data, quality, mixing, chat, licences, joins, sharding.

Nothing else in the library imports this subpackage. Every operator module holds a general
interface (``DataFrame -> DataFrame``); ``queries.py`` binds the operators to the test tables.
"""
