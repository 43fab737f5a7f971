"""Messages the jobs report, as the reference words them."""

# Fixed values of the reference: credit-sheet validation messages.
SHEET_NAME_REQUIRED = "Nome é obrigatório"
SHEET_NAME_TOO_LONG = "Nome muito longo (máximo 255 caracteres)"
SHEET_CPF_REQUIRED = "CPF é obrigatório"
SHEET_CPF_LENGTH = "CPF deve ter 11 dígitos"
SHEET_VALUE_POSITIVE = "Valor deve ser um número positivo"
SHEET_VALUE_MAX = "Valor não pode exceder R$ 1.000.000"

# Fixed values of the reference: collaborator-sheet and collaborator-create messages.
CPF_CHECK_DIGITS = "CPF inválido (verifique os dígitos)"
BIRTH_DATE_INVALID = "Data de nascimento inválida ou no futuro"
EMAIL_INVALID = "Email inválido"
SEX_INVALID = "Sexo deve ser M ou F"
TENANT_REQUIRED = "cliente_id é obrigatório"
CPF_INVALID = "CPF inválido"
CPF_DUPLICATE = "CPF já cadastrado para este cliente"

# Fixed values of the reference: credit-request validation and generation messages.
REQUEST_TOO_MANY = ("Máximo ", " colaboradores permitidos")  # around the limit
REQUEST_LINE = "Colaborador "
REQUEST_LINE_CPF = "CPF inválido"
REQUEST_LINE_ID = "ID inválido"
REQUEST_LINE_VALUE = "Valor inválido ou excede o limite"
REQUEST_DATE_INVALID = "Data de disponibilização inválida"
LINE_NOT_FOUND = "CPF não encontrado ou colaborador inativo"
LINE_VALUE_NOT_POSITIVE = "valor<=0"
