"""Operations for building training data: ten operators and the queries that apply them.

Nothing outside this folder imports it.
"""
