"""All registered queries and their SQL twins."""

from plumbline.workload import requests, store, testlogs, trees

QUERIES = {**trees.QUERIES, **store.QUERIES, **testlogs.QUERIES, **requests.QUERIES}
SQL = {**trees.SQL, **store.SQL, **testlogs.SQL, **requests.SQL}
